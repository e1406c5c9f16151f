import pytest

from quern.__main__ import main


def test_list_run_explain_and_answer(spark, sf, capsys):
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out
    main(["run", "decision_tally", "--data", sf, "--rows", "3"])
    assert "reason" in capsys.readouterr().out
    main(["explain", "vector_range_scan", "--data", sf])
    out = capsys.readouterr().out
    assert "PushedFilters" in out and "GreaterThanOrEqual" in out
    main(["answer", "--data", sf, "hi"])
    assert "query_too_short" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "--data", sf])
