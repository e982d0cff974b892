import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradus.llm.exact_dedup import ascii_lowered, decide, deduplicate, ingest, repeated
from tests.llm.helpers import LOWER, ODD, documents

ROWS = ODD + [(20, "abc é"), (21, "ABC é"), (22, "abc É"), (23, "b"), (24, "B"), (25, "c")]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for doc_id in ids:
            out.append((doc_id, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_decisions_equal_brute_force(spark, tmp_path, digest_bytes):
    path = str(tmp_path / "docs.parquet")
    documents(spark, ROWS).write.parquet(path)
    got = decide(spark, path, digest_bytes=digest_bytes).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_patterns_are_no_paths(spark, tmp_path):
    with pytest.raises(ValueError, match="pattern"):
        ingest(spark, str(tmp_path / "docs[1].parquet"), str(tmp_path / "store"))


def test_other_columns_stay(spark):
    docs = documents(spark, ROWS)
    out = deduplicate(docs)
    assert out.schema == docs.schema
    assert out.count() == len({(text or "").translate(LOWER) for _, text in ROWS})
    assert deduplicate(documents(spark, [])).count() == 0


def test_state_goes_on_when_files_arrive(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    documents(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    ingest(spark, path, store)
    documents(spark, [(3, "A"), (4, "c")]).write.mode("append").parquet(path)
    ingest(spark, path, store)
    ingest(spark, path, store)  # nothing new
    got = repeated(spark, store).select("n", "keep.doc_id").collect()
    assert [tuple(r) for r in got] == [(2, 3)]


def test_lower_case_of_ascii_only(spark):
    texts = ["ABC xyz", "ÀÉ İI ABC ẞ", "Σ A", "", "\x00A\x00", "ſK"]  # the last is a Kelvin sign
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(ascii_lowered(F.col("t"))).collect()]
    assert got == [t.translate(LOWER) for t in texts]
