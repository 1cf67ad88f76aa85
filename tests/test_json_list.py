import json

import pytest

from siltstone.sources import sinks


@pytest.mark.parametrize("header", [False, True])
def test_parts_in_order_are_one_array(spark, tmp_path, header):
    rows = [(k, f'a "quoted"\ttext {k}' if k % 5 else "") for k in range(60)]
    df = spark.createDataFrame(rows, 'Id long, `Sign "On"` string').repartition(7, "Id")
    out = tmp_path / "out"
    sinks.write_json_list(df, str(out), str(tmp_path / "work"), header)
    got = json.loads("".join(p.read_text() for p in sorted(out.glob("part-*"))))
    if header:
        assert got[0] == ["Id", 'Sign "On"'] and {int(r[0]): r[1] for r in got[1:]} == {k: t.replace("\t", " ") for k, t in rows}
    else:
        assert {r["id"]: r.get('sign"on"') for r in got} == {k: t.replace("\t", " ") or None for k, t in rows}


@pytest.mark.parametrize("header", [False, True])
def test_no_rows(spark, tmp_path, header):
    sinks.write_json_list(spark.createDataFrame([], "a long, b string"), str(tmp_path / "out"), str(tmp_path), header)
    got = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert got == ([["a", "b"]] if header else [])
