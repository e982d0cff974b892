"""Every registered query of the subpackage over the smallest tables, held against its SQL."""

import os
import zlib

import duckdb
import pytest

from checks.compare import canonical
from gradus.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import near_groups

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark", "conversations"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in got.collect()]
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, rows) == canonical(columns, result.fetchall())


def test_near_groups_equal_all_pairs(spark, db):
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op10_near_dedup"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == near_groups(docs, 2, 80)


def test_token_counts_equal_the_library(spark, db):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: r.n_tokens for r in QUERIES["op2_token_counts"](spark, SF_DIR).collect()}
    assert got == {i: len(library.encode(t or "")) for i, t in docs.items()}


@pytest.mark.parametrize(("name", "label"), [("op6_quality", "quality"), ("op3_toxicity", "toxic")])
def test_classifiers_mark_the_held_out_rows(spark, db, name, label):
    labels = dict(db.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    got = QUERIES[name](spark, SF_DIR).collect()
    assert len(got) == db.execute("SELECT count(*) FROM documents").fetchone()[0]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if label == "quality" else 0.5))
    # So few labels (under a hundred) teach little; well above chance is enough here.
    known = [r for r in got if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.8 * len(known)


def test_passages_are_those_that_the_text_has(spark, db):
    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    items = dict(db.execute("SELECT item_id, text FROM benchmark").fetchall())

    def flat(text):
        return " ".join((text or "").lower().split())

    want = {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF_DIR).collect()}
    assert want <= got


def test_other_queries_have_a_row_for_each_row(spark, db):
    for name, table in [("op4_secrets", "documents"), ("op7_warc", "pages"), ("op5_chat_format", "conversations")]:
        assert QUERIES[name](spark, SF_DIR).count() == db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
