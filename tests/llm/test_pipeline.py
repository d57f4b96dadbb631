"""The pipeline's rows beside a brute-force version of its stages, and the registered SQL of the text operators."""

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import decontamination, quality_rules, registry

from .test_operators import AWKWARD, SF, brute_components


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "bpe"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF).cache()
        if name != "bpe":
            assert out.columns == columns
        seen.append(out)
    rows = lambda d: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    start, ruled, lines, near, clean = (rows(d) for d in seen[:5])
    verdict = {r["doc_id"] for r in quality_rules.op9_quality_rules(spark, SF).where("kept").select("doc_id").collect()}
    assert set(ruled) == verdict and all(ruled[i] == start[i] for i in ruled)
    assert set(lines) == set(ruled)
    for i, t in lines.items():  # what is left is a subsequence of the lines there were
        left = iter((ruled[i] or "").split("\n"))
        assert t == "" or all(any(x == y for y in left) for x in t.split("\n"))
    kept = {i for i, n, c in brute_components(sorted(lines.items()), 5, 80, 100) if i == c or not n}
    assert set(near) == kept
    found = {r["doc_id"] for r in decontamination.leaks(seen[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(clean) == set(near) - found
    assert {r["doc_id"] for r in seen[5].collect()} == set(clean)
    assert corpus_pipeline.run(spark, SF).count() == len(clean)


def test_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries = registry.queries()
    for name, sql in registry.oracle_sql().items():
        df = queries[name](spark, SF)
        order = sorted(df.columns)
        want = c.sql(sql)
        assert sorted(want.columns) == order
        at = [want.columns.index(k) for k in order]
        assert sorted(tuple(r[k] for k in order) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall()), name


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row string, _n string, row string, n string, doc string, node string, hash string, found string"


def awkward(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or ""), *(f"v{k}{c}" for c in "abcdefgh")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))], CLASH)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a run whose labels and benchmark are small."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, "how many red apples are left when ten of the twelve boys have had one each"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return at


LEAK = "Q: How many red apples are left when ten of the twelve boys have had one each? A: two of them"
PLAIN = "this is a clean text of more than ten different words that nobody rejects here"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, folder, name, stage):
    """Nulls, empty and long texts, ties, repeated rows and columns with the names used inside."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    texts = [*AWKWARD, LEAK, PLAIN, PLAIN, long]
    docs = awkward(spark, texts, [*range(len(AWKWARD)), 50, 51, 52, 53])
    docs = docs.unionByName(docs.where("doc_id in (0, 51)"))  # rows that repeat
    out = stage(spark, docs, str(folder))
    rows = out.collect()
    if name == "bpe":
        assert len(rows) == docs.count()
        return
    assert out.columns == docs.columns
    was = {r["_row"]: r for r in docs.collect()}
    for r in rows:  # every other column is the row's own
        assert all(r[c] == was[r["_row"]][c] for c in docs.columns if c not in ("text", "n_chars"))
    ids = sorted(r["doc_id"] for r in rows)
    if name == "quality_rules":
        assert ids == [50, 51, 51, 52, 53]
    if name == "line_dedup":
        assert ids == sorted(r["doc_id"] for r in docs.collect())
    if name == "ngram_join":  # 6 and 7, 51 and 52 are equal; one row of each stays
        assert ids == sorted({*range(len(AWKWARD)), 50, 51, 53} - {7})
    if name == "decontamination":
        assert ids == sorted([*range(len(AWKWARD)), 0, 51, 51, 52, 53])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    docs = awkward(spark, [PLAIN]).where("doc_id < 0")
    out = stage(spark, docs, str(folder))
    assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_run_on_awkward_rows(spark, folder, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(folder / f"{t}.parquet")).write.parquet(str(tmp_path / f"{t}.parquet"))
    awkward(spark, [*AWKWARD, LEAK, PLAIN, PLAIN], [*range(len(AWKWARD)), 50, 52, 51]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [51]
    awkward(spark, [PLAIN]).where("doc_id < 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(folder / f"{t}.parquet")).write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
