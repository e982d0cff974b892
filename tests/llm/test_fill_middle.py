import hashlib
import re

from pyspark.sql import functions as F

from gradus.llm.fill_middle import fill_in_middle, restored
from tests.llm.helpers import ODD, documents

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def plainly(key, text, seed="7", rate=100, spm_rate=50):
    text = text or ""
    units = LINES.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = ODD + [
    (20, "a\nb\nc"),
    (21, "\n\n\n"),
    (22, "one\r\ntwo\r\n\r\nthree four\x85five\n"),
    (23, "has <P> in it\nand more\n"),
    (24, "ends with <P\n<S\n<M\n>P>\n<<S"),
    (25, "$1 \\n $3\n\\$2\n{2}\n(\n"),
    (26, "\U0001f642\n\U0001f600 é\nñ"),
    (27, "x\n" * 50_000),
    (28, "é" * 200_000 + "\n" + "y" * 200_000),
] + [(100 + i, "l1\nl2\nl3\nl4 tail") for i in range(60)]


def check(spark, rows, **options):
    docs = documents(spark, rows)
    out = fill_in_middle(docs, **options)
    got = out.select(
        "doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output",
        restored(F.col("output"), F.col("form")).alias("back"),
    ).collect()
    assert len(got) == len(rows)
    want = sorted(str((k, *plainly(k, t, **options))) for k, t in rows)
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert all(r.back == r.text for r in got)
    return got


def test_rows_equal_a_plain_version(spark):
    got = check(spark, ROWS)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rates_and_seeds(spark):
    got = check(spark, ROWS, seed="other", rate=40, spm_rate=0)
    assert {r.form for r in got} == {"plain", "psm"}
    assert {r.form for r in check(spark, ROWS, rate=0)} == {"plain"}


def test_empty_table(spark):
    assert fill_in_middle(documents(spark, [])).count() == 0


def test_the_plan_is_one_narrow_pass(spark):
    plan = fill_in_middle(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
