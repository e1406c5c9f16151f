"""Column types of the tables that stages exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**columns) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


_S, _L, _I, _B, _D = StringType(), LongType(), IntegerType(), ByteType(), DoubleType()

RAW = _struct(
    source_lang=_S, target_lang=_S, query_id=_L, query_type=_S,
    passages=_struct(English_passages=ArrayType(_S), Translated_passages=ArrayType(_S), is_selected=ArrayType(_L)),
    Eng_Query=_S, Eng_Answer=_S, query=_S, Answer=_S,
)
PASSAGE = _struct(passage_uid=_S, document_id=_S, query_id=_L, passage_index=_I, lang=_S, is_selected=_B, query=_S, query_en=_S, text=_S)
CHUNK = _struct(chunk_id=_S, passage_uid=_S, document_id=_S, query_id=_L, chunk_index=_I, lang=_S, is_selected=_B, text=_S)
EMBEDDING = _struct(embedding_index=_L, chunk_id=_S, document_id=_S, query_id=_L, chunk_index=_I, lang=_S, is_selected=_B, vector=ArrayType(FloatType(), False))
HIT = _struct(qid=_L, rank=_I, chunk_id=_S, document_id=_S, score=_D, lang=_S, retriever=_S)
DECISION = _struct(reason=_S, grounded=StringType(), ms=_D, confidence=_D, groundedness=_D, query=_S)


class SchemaMismatch(ValueError):
    """A table lacks columns, or holds them with other types."""


def assert_schema(df: DataFrame, schema: StructType, exact: bool = False) -> DataFrame:
    """``df`` itself if it has all columns of ``schema`` with those types, and no others if ``exact``."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = {f.name: have.get(f.name) for f in schema if have.get(f.name) != f.dataType.simpleString()}
    if wrong or exact and [f.name for f in df.schema] != schema.fieldNames():
        raise SchemaMismatch(f"expected {schema.simpleString()}, differing: {wrong}, columns: {df.columns}")
    return df
