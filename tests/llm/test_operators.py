import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, langid, licenses, lmscore, mixing, neardup, packing, quality, queries, sharding, substring
from quern.llm.queries import tokenizer
from quern.storage import materialize

from . import brute
from .conftest import SCHEMA, WORDS, awkward, prose

TEXTS = {r[0]: r[1] for r in awkward()}


def table(df, *names):
    return {r[names[0]]: r for r in df.collect()}


# ---- packing -----------------------------------------------------------------


def check_pieces(pieces, ids_of, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, own in by_doc.items():
        want, copies = ids_of[doc], sum(p.length for p in own) // len(ids_of[doc])
        assert sum(p.length for p in own) == copies * len(want)
        covered = Counter(i for p in own for i in range(p.start, p.start + p.length))
        assert set(covered) == set(range(len(want))) and set(covered.values()) == {copies}
        for p in own:
            assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length] and p.doc_tokens == len(want)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_seq


def test_packing_holds_every_id_once(odd):
    tok = tokenizer().loaded.whole
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in TEXTS.items()}
    pieces = packing.pack(odd, tokenizer).collect()
    seqs = check_pieces(pieces, ids, 2048)
    assert {p.doc_id for p in pieces} == set(TEXTS)
    padding = sum(2048 - sum(p.length for p in own) for own in seqs.values())
    assert padding < 2048 * odd.rdd.getNumPartitions()


def test_packing_leaves_no_words_with_its_workers(spark, odd):
    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.words) + len(x.known) for x in packing._loaded.values())])], ["n"])

    docs = odd.repartition(8).cache()
    assert packing.pack(docs, tokenizer).count() > len(TEXTS)
    assert sum(r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()) == 0


def test_packing_of_nothing(none, nulls):
    assert packing.pack(none, tokenizer).count() == 0
    assert sorted(r.doc_tokens for r in packing.pack(nulls, tokenizer).collect()) == [1, 4]


def test_packing_prefers_the_cheapest_sequence_that_fits():
    p = packing.pack_lengths(np.array([900, 800, 700, 600, 500, 400, 100, 2048 * 2 + 20]), 2048)
    assert sorted(p[p[:, 0] == 7][:, 1:3].tolist()) == [[0, 2048], [2048, 2048], [4096, 20]]
    at = {int(d): int(s) for d, start, n, s, o in p if n != 2048 and d != 7}
    assert at[0] != at[1] and at[2] == at[1] and at[3] == at[0]
    for trial in range(30):
        n = np.random.default_rng(trial).integers(1, 5000, 60)
        p = packing.pack_lengths(n, 2048)
        assert np.array_equal(np.bincount(p[:, 0], p[:, 2]), n)
        assert np.bincount(p[:, 3], p[:, 2]).max() <= 2048 and len(np.unique(p[:, 3])) == -(-int(n.sum() - (n // 2048).sum() * 2048) // 2048) + (n // 2048).sum()


def test_packing_of_long_texts_and_small_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT_BYTES", 64)
    text = prose(random.Random(1), 300) + " " + "z" * 500 + " end"
    enc = tokenizer()
    got = np.frombuffer(enc.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0], "<u4").tolist()
    assert got == enc.loaded.whole.encode(text, add_special_tokens=False).ids + [1]


# ---- sharding ----------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_finds_the_least_capacity(spark, related, shards):
    rows = related.select(F.xxhash64("text").alias("key"), (F.octet_length("text") + 1).cast("long").alias("size"))
    sizes = [r[1] for r in rows.groupBy("key").sum("size").orderBy("key").collect()]
    got, cuts = sharding.capacity_and_cuts(rows, shards)
    assert got == brute.least_capacity(sizes, shards) and len(cuts) == shards - 1
    placed = sharding.shard(related, shards=shards).collect()
    held = Counter()
    for r in placed:
        held[r.shard] += r["size"]
    assert max(held.values()) <= got and len(placed) == related.count()
    for s in held:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))


def test_sharding_keeps_groups_and_a_hot_one_leaves_no_shard_empty(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "hot" * 30 if i % 3 == 0 else prose(rng, 9)) for i in range(900)], "doc_id long, text string")
    placed = sharding.shard(df).join(df, "doc_id")
    assert placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert placed.select("shard").distinct().count() == 16


def test_sharding_takes_anything(odd, none, nulls):
    assert sharding.shard(none).count() == 0 and sharding.shard(nulls).count() == 2
    assert [r["size"] for r in sharding.shard(odd).where("doc_id < 2").orderBy("doc_id").collect()] == [1, 1]


# ---- language identification -------------------------------------------------


def test_langid_learns_from_labelled_rows(spark, sf, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_langid(spark, sf).join(docs, "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert right > 0.95 and got.where("score < 0 OR score > 1").count() == 0
    assert langid.predict(docs, langid.learn(none)).where("lang_pred <> 'und'").count() == 0


def test_langid_ranks_as_written_out():
    def plain(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        padded, n = " " + " ".join(low.split()) + " ", Counter()
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if not (g == " " or k == 3 and g[1] == " "):
                    n[sum(ord(c) << 21 * (k - 1 - j) for j, c in enumerate(g))] += 1
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]

    for text in ("Abc abd, été!", "x", "नमस्ते दुनिया", "the quick brown fox " * 20 + "日本"):
        cleaned = " ".join("".join(c for c in text if c.isalpha() or c == " ").split())
        assert langid.ranked(langid.letters(cleaned)).tolist() == plain(cleaned)


def test_langid_predicts_as_written_out(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(900, "", "en"), (901, None, "fr"), (902, "12 !", "de")]

    def grams(text):
        low, n = "".join(c if c.isalpha() else " " for c in text.lower()), Counter()
        padded = f" {' '.join(low.split())} "
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if not (g == " " or k == 3 and g[1] == " "):
                    n[g] += 1
        return n if low.strip() else Counter()

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))
    first = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))][: langid.PROFILE]
    totals = defaultdict(Counter)
    for _, t, lang in rows:
        totals[lang] += grams(t or "")
    profiles = {lang: {g: i for i, g in enumerate(first(n))} for lang, n in totals.items() if n}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = table(langid.predict(df, langid.learn(df)), "doc_id")
    for d, t, _ in rows:
        own = first(grams(t or ""))
        if not own:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[d].lang_pred == best and got[d].score == pytest.approx(1 - far[best] / (langid.PROFILE * len(own)))


def test_langid_takes_anything(odd, none, nulls):
    assert langid.predict(none, langid.learn(odd)).count() == 0
    profiles = langid.learn(odd)
    got = table(langid.predict(odd, profiles), "doc_id")
    assert set(got) == set(TEXTS)
    for d, r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in TEXTS[d] or "")), d
    assert {r.lang_pred for r in langid.predict(nulls, profiles).collect()} <= {"und", "en", "fr"}


# ---- pseudo-likelihood -------------------------------------------------------


def test_lmscore_sums_what_the_network_says(spark, odd):
    vocab = lmscore.vocabulary(odd)
    weights = lmscore.fit(odd, vocab, rounds=1)
    got = table(lmscore.score(odd, vocab, weights), "doc_id")
    net = lmscore.Network(vocab.size, weights)
    for d in (6, 9, 12, 13):
        chunk = lmscore.Chunk(lmscore._LOWER[np.frombuffer(TEXTS[d].encode(), np.uint8)], np.array([0, len(TEXTS[d].encode())]))
        ids, total = [0, 0, *vocab.ids(chunk).tolist(), 0, 0], 0.0
        for i in range(2, len(ids) - 2):
            h = np.tanh(sum(net.near[k][ids[i + s]].astype(float) for k, s in enumerate((-2, -1, 1, 2))))
            own, at = divmod(ids[i] - 1, lmscore.WIDE)
            z, q = h @ net.top + net.top_bias, h @ net.out[own] + net.out_bias[own]
            q = q[: vocab.size - own * lmscore.WIDE]
            total += z[own] - np.log(np.exp(z).sum()) + q[at] - np.log(np.exp(q).sum())
        assert got[d].log_prob == pytest.approx(total, rel=1e-3) and got[d].n_tokens == len(ids) - 4
    assert got[0].log_prob == got[1].log_prob == 0 and got[0].mean_log_prob is None


def test_lmscore_gradients():
    rng = np.random.default_rng(3)
    net = lmscore.Network(150)
    around, token = rng.integers(0, 151, (40, 4)), rng.integers(1, 151, 40)
    net.flat[:] += rng.standard_normal(len(net.flat)).astype(np.float32) * 0.2
    loss = lambda: -net.log_prob(around, token).mean()
    for weight, _, part, rows in list(net.gradients(around, token)):
        grad = np.zeros_like(weight)
        grad[rows] = part
        weight, grad = weight.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            was = weight[i]
            weight[i] = was + 0.01
            up = loss()
            weight[i] = was - 0.01
            down = loss()
            weight[i] = was
            assert grad[i] == pytest.approx((up - down) / 0.02, rel=0.05, abs=1e-4)


def test_lmscore_steps_do_not_grow_with_the_classes():
    rng, steps = np.random.default_rng(4), set()
    for vocab in (150, 4096):
        net = lmscore.Network(vocab)
        steps.add(len(list(net.gradients(rng.integers(0, vocab + 1, (9000, 4)), rng.integers(1, vocab + 1, 9000)))))
    assert steps == {5}  # each kind of weights once a batch, not once a class


def test_lmscore_with_large_weights():
    rng = np.random.default_rng(5)
    net = lmscore.Network(150)
    net.flat[:] = rng.standard_normal(len(net.flat)) * 60  # beyond what exp takes without a shift
    around, token = rng.integers(0, 151, (60, 4)), rng.integers(1, 151, 60)
    got = net.log_prob(around, token)
    h = np.tanh(sum(net.near[k][around[:, k]].astype(float) for k in range(4)))
    for i, (own, at) in enumerate(zip(*divmod(token - 1, lmscore.WIDE), strict=True)):
        z, q = h[i] @ net.top + net.top_bias, (h[i] @ net.out[own] + net.out_bias[own])[: 150 - own * lmscore.WIDE]
        want = z[own] - np.logaddexp.reduce(z) + q[at] - np.logaddexp.reduce(q)
        assert got[i] == pytest.approx(want, rel=1e-3, abs=1e-2)
    assert all(np.isfinite(part).all() for _, _, part, _ in net.gradients(around, token))


def test_lmscore_keys_tell_shapes():
    words = ["abc", "a1", "-", "a-b", "é", "é-", "é1-", "x" * 9, "ABC"]
    raw = [f" {w}  ".encode() for w in words] + [b"  ", b""]
    chunk = lmscore.Chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert (lmscore._keys(chunk) & np.uint64(31)).tolist() == [2, 9, 16, 18, 25, 18, 11, 7, 18]
    assert len(lmscore._keys(lmscore.Chunk(np.frombuffer(b"  ", np.uint8), np.array([0, 2])))) == 0


def test_lmscore_fit_is_the_mean_of_its_shards(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 80, 300]))) for i in range(60)] + [(5, "a text of its own"), (90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = lmscore.vocabulary(docs, words=100)
    want = lmscore.Network(vocab.size).flat.astype(float)
    dealt = lmscore.shards(docs, "text", "doc_id", 2, vocab.tokens, 2000).collect()
    assert len(dealt) == 61 and len({r.shard for r in dealt}) == -(-vocab.tokens // 4000)
    for turn in range(2):
        own, n = [], []
        for k in sorted({r.shard for r in dealt if r.turn == turn}):
            texts = [r.text for r in sorted((r for r in dealt if (r.turn, r.shard) == (turn, k)), key=lambda r: (r.mark, r.text))]
            flat, tokens = lmscore.train_shard(pa.array(texts), vocab, want)
            own.append(flat)
            n.append(-(-tokens // 1000))
        want = np.average(np.array(own, float), axis=0, weights=n)
    for parts in (1, 4, 211):
        got = lmscore.fit(docs.repartition(parts), vocab, rounds=2, shard_tokens=2000)
        assert np.allclose(got, want, atol=1e-5)
        first = got if parts == 1 else first
        assert (got == first).all()


def test_lmscore_prefers_texts_like_the_corpus(spark):
    rng = random.Random(2)
    chain = " ".join(f"a{i % 12} b{i % 12}" for i in range(400))
    docs = spark.createDataFrame([(i, chain) for i in range(30)], "doc_id long, text string")
    vocab = lmscore.vocabulary(docs)
    weights = lmscore.fit(docs, vocab, rounds=2)
    words = chain.split()
    rng.shuffle(words)
    tried = spark.createDataFrame([(1, chain), (2, " ".join(words))], "doc_id long, text string")
    got = table(lmscore.score(tried, vocab, weights), "doc_id")
    assert got[1].mean_log_prob > got[2].mean_log_prob + 1


def test_lmscore_trains_on_every_document(spark):
    docs = spark.createDataFrame([(i, f"only{i} " * 30) for i in range(60)], "doc_id long, text string")
    vocab = lmscore.vocabulary(docs)
    before, after = lmscore.Network(vocab.size), lmscore.Network(vocab.size, lmscore.fit(docs, vocab))
    assert len(vocab.hashes) == 60
    assert (before.near != after.near).any(2)[:, 1 + lmscore.BUCKETS :].all()  # each word stands in one document only


def test_lmscore_spreads_copies_over_rounds_and_shards(spark):
    docs = spark.createDataFrame([(i, "one text in many copies") for i in range(90)], "doc_id long, text string")
    dealt = lmscore.shards(docs, "text", "doc_id", 3, 90 * 5, 50).collect()
    assert len(dealt) == 90 and {(r.turn, r.shard) for r in dealt} == {(t, k) for t in range(3) for k in range(3)}


def test_lmscore_tells_rare_words_apart_by_their_neighbours(spark):
    rng = random.Random(7)
    many = [f"{a}{b}{c}zzzzz" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]  # 216 words of one shape
    docs = spark.createDataFrame([(i, " ".join(x for _ in range(40) for x in ("left", many[0], "right", many[1]))) for i in range(60)], "doc_id long, text string")
    vocab, words = lmscore.lexicon(docs, words=2)
    assert len(vocab.hashes) == 2
    weights = lmscore.fit(docs, vocab)
    tried = spark.createDataFrame([(0, f"left {many[0]} right"), (1, f"left {many[1]} right"), (2, f"left {rng.choice(many[2:])} right")], "doc_id long, text string")
    got = table(lmscore.score(tried, vocab, weights, words=words), "doc_id")
    assert got[0].log_prob > got[1].log_prob + 1 and got[1].log_prob > got[2].log_prob


def test_lmscore_counts_words_within_buckets(spark, tmp_path):
    rng = random.Random(7)
    many = [f"{a}{b}{c}zzzzz" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    rows = [(i, " ".join(rng.choice(many) for _ in range(60))) for i in range(200)] + [(1002, "some rare xyzzyxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op4_lmscore(spark, str(tmp_path)).count() == 201
    counts = Counter(w for _, t in rows for w in t.split())
    vocab, words = lmscore.lexicon(docs, words=20)
    key = lambda w: lmscore._keys(lmscore.Chunk(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])))
    top, find = {w for w in counts if np.isin(key(w), vocab.hashes)[0]}, words.finder()
    assert len(top) == 20 and vocab.tokens == sum(counts.values())
    by_bucket = defaultdict(dict)
    for w, n in counts.items():
        if w not in top:
            by_bucket[int(lmscore._bucket(key(w))[0])][w] = n
    for k, held in by_bucket.items():
        rare, total = [n for n in held.values() if n < lmscore.FLOOR], sum(held.values()) + 1
        for w, n in held.items():
            p = n if n >= lmscore.FLOOR else (sum(rare) + 1) / (len(rare) + 1)
            assert find(key(w))[0] == pytest.approx(np.log(p / total), rel=1e-4, abs=1e-5)
        assert sum(np.exp(find(key(w))[0]) for w in held) + np.exp(words.rare[k]) == pytest.approx(1, rel=1e-4)


def test_lexicon_of_nothing(spark, none, nulls):
    vocab, words = lmscore.lexicon(none)
    assert len(vocab.hashes) == 0 and lmscore.score(none, vocab, lmscore.fit(none, vocab), words=words).count() == 0
    assert all(np.isfinite(r.log_prob) for r in lmscore.score(nulls, vocab, lmscore.fit(none, vocab), words=words).collect())


def test_lmscore_of_nothing(none, nulls):
    vocab = lmscore.vocabulary(none)
    weights = lmscore.fit(none, vocab)
    assert lmscore.score(none, vocab, weights).count() == 0 and lmscore.score(nulls, vocab, weights).count() == 2


# ---- mixing ------------------------------------------------------------------


GOALS = [{0: 32, 1: 20, 2: 12}, {0: 1, 1: 1}, {0: 63, 1: 1}, {0: 7}, {i: i + 1 for i in range(9)}, {0: Fraction(7, 10_000), 1: Fraction(3001, 10_000), 2: Fraction(6992, 10_000)}, {i: Fraction(1, p) for i, p in enumerate((3, 7, 11, 13, 5000))}]


@pytest.mark.parametrize("goal", GOALS)
def test_pfair_lags_less_than_a_block(goal):
    goal = {s: Fraction(w) for s, w in goal.items()}
    total, got = sum(goal.values()), Counter()
    slots = mixing.phase(dict.fromkeys(goal, 30_000), goal)
    assert max(Counter(slots).values()) == 30_000
    for slot, s in enumerate(slots):
        w, j = goal[s] / total, got[s]
        assert int(j / w) <= slot < -int(-(j + 1) // w)
        got[s] += 1
        if slot % 101 < 3 or slot < 400:
            assert all(abs(got[k] - n * (slot + 1) / total) < 1 for k, n in goal.items())


def by_hand(left, goal):
    """Earliest deadline first, looking at every source in every slot."""
    got, out, total = Counter(), [], sum(goal[s] for s in left)
    while not out or got[out[-1]] < left[out[-1]]:
        t = len(out)
        ready = [(-int(-(got[s] + 1) // (goal[s] / total)), s) for s in left if int(got[s] / (goal[s] / total)) <= t]
        out.append(min(ready)[1])
        got[out[-1]] += 1
    return out


def test_plan_uses_each_block_once():
    goal = {0: Fraction(1, 2), 1: Fraction(1, 4), 2: Fraction(1, 4), 4: Fraction(0)}
    blocks = {0: 100, 1: 7, 2: 31, 3: 0, 4: 5}
    sources, phases = mixing.plan(blocks, goal)
    assert Counter(sources.tolist()) == {0: 100, 1: 7, 2: 31, 4: 5} and (np.diff(phases) >= 0).all() and set(sources[phases == phases.max()].tolist()) == {4}
    assert sources[phases == 0].tolist() == by_hand({0: 100, 1: 7, 2: 31}, goal)


def test_mixing_is_the_schedule_by_hand(related, odd, none, nulls, monkeypatch):
    goal = {"s0": 0.0007, "s1": 0.3001, "s2": 0.6992}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    got = mixing.schedule(related, goal, block_bytes=50)
    assert got.count() == got.select("doc_id").distinct().count() == related.count()
    total = Counter()
    for r in related.collect():
        total[r.source] += max(1, len(r.text.encode()))
    left, exact, order = {s: -(-n // 50) for s, n in total.items()}, {s: Fraction(str(w)) for s, w in goal.items()}, []
    while left:
        run = by_hand(left, exact)
        order += run
        left = {s: n for s in left if (n := left[s] - run.count(s))}
    nth, want = Counter(), {}
    for slot, s in enumerate(order):
        want[s, nth[s]] = slot
        nth[s] += 1
    place = defaultdict(list)
    for r in got.collect():
        assert r.slot == want[r.source, r.block]
        place[r.source].append(50 * r.block + r.within)
    sizes = {s: sorted(p) for s, p in place.items()}
    assert all(p[0] == 0 and len(set(p)) == len(p) for p in sizes.values())
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(mixing.schedule(related, goal, block_bytes=50).collect()) == sorted(got.collect())
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    few = mixing.schedule(related, goal, block_bytes=50).agg(F.max("slot")).head()[0]
    assert few < 43
    mixed = mixing.interleave(odd, block_bytes=500)
    assert mixed.columns == odd.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, odd.collect()))
    assert mixing.interleave(none).count() == 0 and mixing.schedule(none).count() == 0 and mixing.schedule(nulls).count() == 2


# ---- nearest neighbours ------------------------------------------------------


def neighbours(rows, query, k):
    own = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            own.setdefault(i, []).append(np.array(v, float))
    if query not in own:
        return []
    best = [(min(float(np.sqrt(((q - x) ** 2).sum())) for q in own[query] for x in xs), i) for i, xs in own.items() if i != query]
    return [(i, d) for d, i in sorted(best)[:k]]


def test_ann_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((24, 16))
    many = [(i, (centres[i % 24] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    for own, by in ((rows, 100), (many, 50)):
        df = spark.createDataFrame(own, "vec_id long, embedding array<float>")
        exact = [(r.vec_id, r.embedding) for r in df.collect()]
        got = defaultdict(list)
        for r in ann.search(df, F.col("vec_id") % by == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        hit = total = 0
        for q in [i for i, _ in own if i % by == 0]:
            want = neighbours(exact, q, 10)
            assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))
            hit, total = hit + len({i for i, _ in want} & {i for i, _ in got[q]}), total + 10
        assert hit >= 0.9 * total


def test_ann_takes_anything(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 2.0]), (9, [1.0]), (None, [1.0, 1.0]), (100, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS part", "2 AS ID")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 6), (0, 2, 7), (0, 3, 8), (0, 4, 100)]
    assert [r[3] for r in got if r[0] == 0] == [0.0, 0.0, 5**0.5, 20**0.5]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8))
    part = ann.balanced_parts(ann.sample_graph(x, 5), 8, rng)
    assert np.bincount(part).tolist() == [50] * 8


# ---- substring ---------------------------------------------------------------


@pytest.mark.parametrize("length", [5, 20])
def test_substring_removes_what_stands_earlier(related, length):
    docs = [(r.doc_id, r.text) for r in related.select("doc_id", "text").collect()]
    want, got = brute.cut_repeats(docs, length), table(substring.dedup(related, length=length, keep=("lang",)), "doc_id")
    assert len(got) == len(docs) and sum(len(g) for _, g in want.values()) > 500
    for d, (words, gone) in want.items():
        r = got[d]
        assert {i for s in r.spans for i in range(s.start, s.end)} == gone and r.n_removed == len(gone)
        assert brute.WORD.findall(r.text) == [w for i, w in enumerate(words) if i not in gone]
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and r.lang == "en"


def test_substring_in_low_entropy_texts(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("ab" if i % 2 else "a") for _ in range(60))) for i in range(20)] + [(50, "ab ab " * 40), (51, "q " * 19), (52, "q " * 21)]
    got = table(substring.dedup(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")
    for d, (words, gone) in brute.cut_repeats(docs).items():
        assert got[d].n_removed == len(gone), d


def test_substring_takes_anything(spark, odd, none, nulls):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", odd["n_chars"], F.expr("doc_id")).join(spark.createDataFrame(list(TEXTS.items()), "d long, text string"), F.col("d") == odd["doc_id"]).select(odd["doc_id"], "text").distinct().collect()]
    want, rows = brute.cut_repeats(docs), substring.dedup(odd).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.n_removed == len(want[r.doc_id][1]) and (r.text is None) == (TEXTS[r.doc_id] is None)
    assert substring.dedup(none).count() == 0 and substring.dedup(nulls).count() == 2


# ---- licenses ----------------------------------------------------------------


def test_licenses_match_exactly(spark):
    rng, rows = random.Random(4), []
    notices = list(licenses.TEMPLATES.values())
    for i in range(200):
        words = rng.choice(notices).split()
        kept = [w for w in words if rng.random() > 0.12]
        rng.shuffle(kept)
        rows.append((i, "\n".join([prose(rng, 6), " ".join(kept) + " " + prose(rng, 4), prose(rng, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = table(licenses.scan(df), "doc_id")
    for d, text in rows:
        want = set()
        for b, line in enumerate(text.split("\n")):
            own = set("".join(c if c.isalnum() else " " for c in line.lower()).split())
            for name, notice in licenses.TEMPLATES.items():
                t = set(licenses._distinct(notice))
                if len(t & own) >= licenses.THRESHOLD * len(t) - 1e-9:
                    want.add((b, name, round(len(t & own) / len(t), 9)))
        assert {(m.block, m.template, round(m.containment, 9)) for m in got[d].matches} == want


def test_licenses_match_wrapped_notices(spark):
    rng, rows, want = random.Random(8), [], {}
    for name, notice in licenses.TEMPLATES.items():
        words = notice.split()
        for cut in range(1, len(words)):
            for mark in ("\n", "\n# ", " \n\n * "):
                want[len(rows)] = name
                rows.append((len(rows), f"{prose(rng, 30)}\n{' '.join(words[:cut])}{mark}{' '.join(words[cut:])} {prose(rng, 30)}\n{prose(rng, 4)}"))
    got = table(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    for d, name in want.items():
        assert [m.template for m in got[d].matches].count(name) == 1, rows[d]


def test_licenses_wrap_as_they_are_printed(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this"
    thin = "\n".join("Released under the MIT License".split())
    far = "Released under the\n" + "other words " * 9 + "MIT License"
    twice = "Released under the MIT License.\nReleased under the MIT License."
    rows = list(enumerate([bsd, mpl, thin, far, twice, "", "\n\n"]))
    got = table(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    found = lambda d: [(m.block, m.template) for m in got[d].matches]
    assert found(0) == [(0, "bsd-3-clause")] and found(1) == [(0, "mpl-2.0")] and found(2) == [(0, "mit")]
    assert found(3) == [] and found(4) == [(0, "mit"), (1, "mit")] and found(5) == found(6) == []


def test_license_places(spark):
    rows = [(1, "MIT License and the mit-license, limit license"), (2, "GNU General\nPublic...License; apache LICENSE"), (3, "mitlicense mit  licenses"), (4, "é mit\nlicense"), (5, None), (6, "")]
    got = table(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert [(p.word, p.label) for p in got[1].places] == [(0, "mit"), (4, "mit")]
    assert sorted((p.word, p.label) for p in got[2].places) == [(1, "gpl"), (4, "apache")]
    assert not got[3].places and [(p.word, p.label) for p in got[4].places] == [(1, "mit")] and not got[5].places and got[5].n_words == got[6].n_words == 0


def test_licenses_take_anything(odd, none, nulls):
    assert licenses.scan(odd).count() == len(TEXTS) + 1 and licenses.scan(none).count() == 0 and licenses.scan(nulls).count() == 2


# ---- near duplicates ---------------------------------------------------------


@pytest.mark.parametrize("words", [2, 5])
def test_neardup_finds_all_components(related, words):
    docs = [(r.doc_id, r.text) for r in related.select("doc_id", "text").collect()]
    want = brute.components(docs, words)
    got = table(neardup.classes(related, words=words), "doc_id")
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) and r.n_shingles == len(brute.shingles(dict(docs)[d], words)) for d, r in got.items())


def loose(spark):
    rng = random.Random(6)
    base, docs = prose(rng, 150).split(), []
    for i in range(150):
        docs.append((i, " ".join(rng.choice(WORDS) if rng.random() < rng.choice([0.01, 0.05, 0.09]) else w for w in base)))
    return spark.createDataFrame(docs, "doc_id long, text string"), brute.components(docs, 2)


def test_neardup_in_large_mixed_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    df, want = loose(spark)
    assert {r.doc_id: r.component_id for r in neardup.classes(df, words=2).collect()} == want


def test_neardup_recall_where_all_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "MEMBERS", 4)
    df, want = loose(spark)
    got = {r.doc_id: r.component_id for r in neardup.classes(df, words=2).collect()}
    linked = {d for d, c in want.items() if c != d}
    assert all(want[d] == want[c] for d, c in got.items())  # no false link
    assert sum(got[d] == want[d] for d in linked) >= 0.97 * len(linked)


@pytest.mark.parametrize("most", [2, 4, 16])
def test_neardup_loses_nothing_in_large_nodes(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "MEMBERS", most)  # both nodes and prefixes are beyond it
    df, want = loose(spark)
    assert {r.doc_id: r.component_id for r in neardup.classes(df, words=2).collect()} == want


def test_neardup_nodes_do_not_grow_with_a_common_shingle(spark):
    rng = random.Random(21)
    docs = [(i, " ".join(["of the"] * 3 + [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(6)])) for i in range(3000)]
    sets = neardup._describe(spark.createDataFrame(docs, "doc long, text string"), 2)
    nodes = neardup._nodes(sets, 80).groupBy("key").count().where("count > 1").collect()
    assert max((r["count"] for r in nodes), default=0) < 500  # "of the" is in all, and so the least one of many coordinates


@pytest.mark.parametrize("share", [20, 50, 80, 95, 100])
def test_neardup_misses_few_pairs(share):
    wide, n = neardup._bands(share)
    assert wide * n <= neardup.COORDINATES and (1 - (share / 100) ** wide) ** n <= neardup.MISSED


def test_neardup_large_settled_nodes_need_no_prefixes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 20)
    docs = [(7, d, b"", 0 if d < 200 else d) for d in range(204)]
    rows = spark.createDataFrame(docs, "key long, doc long, sketch binary, label long")
    got = neardup._several(materialize(rows.select("key", "doc"), "nodes"), materialize(rows.select("doc", "label", "sketch"), "labels"), False)
    nodes = got.groupBy("key").agg(F.collect_set("doc").alias("m")).collect()
    met = {(a, b) for n in nodes for a in n.m for b in n.m}
    assert got.where("NOT small").isEmpty() and all((a, b) in met for a in range(200, 204) for b in range(204)) and max(len(n.m) for n in nodes) <= 40


def test_neardup_slices_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 6)
    rows = spark.createDataFrame([(7, d, d % 5 * (d > 20), b"", True) for d in range(40)], "key long, doc long, label long, sketch binary, small boolean")
    nodes = neardup._sliced(materialize(rows, "rows")).groupBy("key").agg(F.collect_list(F.struct("doc", "label")).alias("m")).collect()
    met = {(a.doc, b.doc) for n in nodes for a in n.m for b in n.m if a.label != b.label}
    assert met == {(a, b) for a in range(40) for b in range(40) if a % 5 * (a > 20) != b % 5 * (b > 20)}
    assert all(len({a.doc for a in n.m}) == len(n.m) for n in nodes) and max(len(n.m) for n in nodes) < 30


def test_neardup_takes_anything(odd, none, nulls):
    got = neardup.classes(odd, words=2).collect()
    want = brute.components(sorted(TEXTS.items()), 2)
    assert len(got) == len(TEXTS) + 1 and {r.doc_id: r.component_id for r in got} == want
    assert neardup.classes(none).count() == 0
    assert [(r.component_id, r.kept) for r in neardup.classes(nulls).collect()] == [(None, True)] * 2
    kept = neardup.keep(odd, words=2)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.collect()) == sorted({*want.values()})


def test_neardup_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(12)
    alone, copied, other = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(7, alone, "a"), (7, copied, "b"), (3, copied, "c"), (9, other, "d"), (9, other, "e"), (12, other + " tail", "f"), (None, copied, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = neardup.keep(df, words=2)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(7, alone), (3, copied), (9, other), (None, copied)], key=str)


# ---- quality -----------------------------------------------------------------

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts(odd, related):
    for df in (odd, related.union(related.selectExpr("doc_id", "concat(text, '\n', text, '\n#|') AS text", "lang", "source", "n_chars").limit(9))):
        texts = defaultdict(set)
        for r in df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select("c0", "c1").collect():
            texts[r[0]].add(r[1])
        for r in quality.judge(df, report=COUNTS).collect():
            assert tuple(r[c] for c in COUNTS) in {brute.quality(t) for t in texts[r.doc_id]}


def test_quality_verdict_does_not_depend_on_the_order(odd, none, nulls):
    want = {d: quality.judge(odd).count() for d in ()}
    results = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        results.append(sorted((r.doc_id, r.kept) for r in quality.judge(odd, rules=rules).collect()))
    assert results[0] == results[1] and not want
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.collect()) == [d for d, k in results[0] if k]
    assert quality.judge(none).count() == 0 and not any(r.kept for r in quality.judge(nulls).collect())


def test_quality_orders_rules_by_rejection_per_cost(spark):
    never = quality.Rule("never", lambda c: np.ones(len(c["n_words"]), bool))
    always = quality.Rule("always", lambda c: np.zeros(len(c["n_words"]), bool))
    assert [r.name for r, _, _ in quality.ordered(["a b c"] * 9, [never, always])] == ["always", "never"]


def test_quality_order_does_not_depend_on_the_run(spark, odd, none, nulls, related):
    plans = [[r.name for r in quality.plan_rules(related.repartition(n))] for n in (1, 3, 7)]
    assert plans[0] == plans[1] == plans[2] and quality.keep(none).count() == 0 and quality.keep(nulls).count() == 0
    assert len(quality.plan_rules(odd, sample_rows=3)) == len(quality.RULES)
    few = [r.failed_rule for r in quality.judge(odd.repartition(5)).orderBy("doc_id").collect()]
    assert few == [r.failed_rule for r in quality.judge(odd.repartition(2)).orderBy("doc_id").collect()]


def test_quality_keeps_clean_prose(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([(i, ". ".join(prose(rng, 9).capitalize() for _ in range(12)) + ".") for i in range(20)], "doc_id long, text string")
    assert quality.keep(df).count() == 20


# ---- digests -----------------------------------------------------------------


def test_digests_of_queries(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for p in queries.op1_packing(spark, sf).where("start = 0").limit(20).collect():
        ids = tokenizer().loaded.whole.encode(docs[p.doc_id], add_special_tokens=False).ids + [1]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[: p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
    for r in queries.op2_sharding(spark, sf).collect():
        raw = docs[r.doc_id].encode()
        assert r.text_crc32 == zlib.crc32(raw) and r["size"] == len(raw) + 1 and r.law == "bytes" and r.grown_shard is None
    cut = brute.cut_repeats(sorted(docs.items()))
    for r in queries.op7_substring(spark, sf).collect():
        words, gone = cut[r.doc_id]
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and r.n_words == len(words)
