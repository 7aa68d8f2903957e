"""Any form of a marker table gives the same results."""

import pandas as pd
import pyarrow as pa
import pytest

from markerloom import MarkerTable, api
from markerloom.sources import writers
from markerloom.types import MarkerError
from tests import brute

ROWS = [("4", "CATTAG", 3, 0, 9, 2, 0, 1), ("11", "GGTTCA", 6, 7, 0, 8, 0, 0), ("7", "TTAACCG", 0, 0, 0, 0, 12, 4), ("9", "ACAC", 1, 1, 1, 1, 1, 1)]
NAMES = ["id", "sequence", "a1", "a2", "b1", "a3", "b2", "b3"]
POP = [(x, {"a": "alpha", "b": "beta"}[x[0]]) for x in NAMES[2:]]
LISTS = [(r[0], r[1], list(r[2:])) for r in ROWS]


@pytest.fixture(scope="module")
def forms(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("api")
    frame = pd.DataFrame(ROWS, columns=NAMES)
    (d / "t.tsv").write_text("\t".join(NAMES) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in ROWS))
    (d / "p.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in POP))
    table = MarkerTable.from_dataframe(frame, POP)
    writers.write_parquet(table, f"{d}/t.parquet")
    return str(d), [str(d / "t.tsv"), f"{d}/t.parquet", frame, pa.Table.from_pandas(frame), spark.createDataFrame(frame), table]


def test_forms_agree(forms):
    d, all_forms = forms
    strict = {i for i, x in brute.tested(LISTS, POP, ("alpha", "beta"), 1, brute.p_g).items() if x[3] < 0.1}
    assert 0 < len(strict) < 4
    for popmap in (POP, f"{d}/p.tsv", pa.table({"i": [a for a, _ in POP], "g": [b for _, b in POP]})):
        for m in all_forms:
            got = api.signif_to_arrow(m, popmap, correction="none", test="gtest", threshold=0.1, depths=False)
            assert set(got.column("id").to_pylist()) == strict
    for m in all_forms:
        assert api.freq_to_arrow(m, POP).sort_by("Frequency").column("Count").to_pylist() == [n for _, n in brute.freq(LISTS, 6)]
        got = api.depth_to_arrow(m, POP, min_frequency=0.5)
        assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(brute.depth(LISTS, POP, 0.5))
    params = api.TriageParams("alpha", "beta", min_depth=1, bayes_factor_threshold=4.0)
    found = api.triage(all_forms[0], POP, params)
    assert found.summary()["candidates"] == found.count() == len(found.to_pandas()) == pa.table(found).num_rows == sum(brute.factor(*brute.cell(x, POP, ("alpha", "beta")), 3, 3) > 4 for _, _, x in LISTS) > 0
    assert api.triage_to_arrow(all_forms[0], POP, bayes_factor_threshold=4).num_rows == found.count()
    assert api.pca_to_arrow(all_forms[2])[1].num_rows == 6 and api.distrib_to_arrow(all_forms[2], POP).num_rows == 15 and api.subset_to_arrow(all_forms[2], POP).num_rows == 4
    with pytest.raises(MarkerError):
        api.freq_to_arrow(all_forms[0], pa.table({"i": ["a1"]}))


def test_back_to_frames(forms, tmp_path):
    table = forms[1][-1]
    assert table.to_pandas().sort_values("id").astype({"id": str}).values.tolist() == sorted(([*r] for r in ROWS), key=lambda r: int(r[0]))
    assert pa.table(table).num_rows == 4 and table.summary() == {"n_markers": 4, "n_individuals": 6}
    api.merge([forms[1][0], forms[1][1]], f"{tmp_path}/m.tsv")
    assert len(open(f"{tmp_path}/m.tsv").read().splitlines()) == 6
    (tmp_path / "reads").mkdir()
    (tmp_path / "reads" / "x.fa").write_text(">one\nTTGC\n>two\nTT\nGC\n")
    api.process(f"{tmp_path}/reads", f"{tmp_path}/r.tsv")
    assert open(f"{tmp_path}/r.tsv").read().splitlines()[-1] == "0\tTTGC\t2"
