import random

import corpus_pipeline
from gradus.llm.mixing import mix
from gradus.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import LOWER, near_groups
from tests.llm.test_classifiers import quality_corpus
from tests.llm.test_decontaminate import LETTERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write_tables(spark, folder):
    draw = random.Random(3)
    rows, labels = quality_corpus(size=240)
    item = "".join(draw.choices(LETTERS, k=150))
    texts = dict(rows)
    good = [i for i, y, _ in labels if y][:120]
    next_id = 1_000
    for i in good[:10]:
        rows.append((next_id, texts[i].upper().lower()))
        next_id += 1
    near = []
    for i in good[10:20]:
        words = texts[i].split()
        words[3] = "changed"
        near.append(next_id)
        rows.append((next_id, " ".join(words)))
        next_id += 1
    leaked = [2_000, 2_001]
    rows += [(i, f"{texts[good[30]][:80]} {item} {texts[good[40 + i - 2000]]}") for i in leaked]
    table = [(i, t, "en", f"s{(i or 0) % 3}", len(t)) for i, t in rows]
    table += [(None, "river stone walk morning", None, None, None), (3_000, None, "en", "s1", 0)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, {i for i, y, _ in labels if not y}, leaked, item


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    _, bad, leaked, item = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = after = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "source_mix":
            assert docs.columns == columns
        if name == "quality":
            ids = {i for i, _ in after}
            assert not ids & bad and {i for i, _ in before if i is not None and i not in bad and i != 3_000} <= ids
        elif name == "exact_dedup":
            groups = {}
            for i, t in before:
                groups.setdefault((t or "").translate(LOWER), []).append(i if i is not None else -1)
            assert sorted(i if i is not None else -1 for i, _ in after) == sorted(map(max, groups.values()))
        elif name == "near_dedup":
            want = [r[0] for r in near_groups([x for x in before if x[0] is not None], 5, 80) if r[3]]
            assert sorted(i for i, _ in after if i is not None) == sorted(want)
            assert sum(i is None for i, _ in after) == sum(i is None for i, _ in before)
        elif name == "decontamination":
            assert sorted(map(str, after)) == sorted(str(x) for x in before if item not in (x[1] or ""))
            assert not {i for i, _ in after} & set(leaked)
    plain = mix(spark.read.parquet(f"{folder}/decontamination"))
    assert sorted((r.doc_id or -1, r.copy) for r in plain.collect()) == sorted(
        (r.doc_id or -1, r.copy) for r in docs.collect()
    )
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
