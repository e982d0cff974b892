import random

from gradus.llm import decontaminate as D
from gradus.llm.decontaminate import Index, decontaminate, find_passages, normalised
from tests.llm.helpers import ODD, documents

LETTERS = "abcdefghij klmno pqrstuvwxyz é"


def least_edits(part, text):
    """Edits of the best place of ``part`` in ``text``, by the full table."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(part, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != c)))
        before = row
    return min(before)


def spoiled(draw, text, edits):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + 1] = draw.choice([[], [draw.choice(LETTERS)], [out[at], draw.choice(LETTERS)]])
    return "".join(out)


def windows(index):
    """All windows: item, place in it, characters, edits allowed."""
    return [
        (i, at, list(codes[at : at + index.size[i]]), index.budget[i])
        for i, codes in enumerate(index.codes)
        for at in range(len(codes) - index.size[i] + 1)
    ]


def test_windows_found_equal_full_alignment():
    draw = random.Random(4)
    items = [(i, "".join(draw.choices(LETTERS, k=draw.randrange(15, 130)))) for i in range(12)]
    index = Index(items)
    every = windows(index)
    found = 0
    for _ in range(160):
        item = draw.randrange(12)
        text = items[item][1]
        start = draw.randrange(0, max(1, len(text) - 60))
        body = spoiled(draw, text[start : start + 110], draw.randrange(0, 9))
        noise = ["".join(draw.choices(LETTERS, k=draw.randrange(0, 40))) for _ in range(2)]
        codes = normalised(noise[0] + body.upper() + noise[1])[0]
        want = {(i, at) for i, at, part, k in every if i == item and least_edits(part, list(codes)) <= k}
        have = {(i, at) for i, at, *_ in index.regions(codes) if i == item}
        assert have == want
        found += len(want)
    assert found > 200


def test_quotes_are_found_wherever_they_begin():
    draw = random.Random(12)
    item = "".join(draw.choices(LETTERS, k=400))
    item = " ".join(item.split()).ljust(400, "x")
    index = Index([(1, item)])
    for size in (80, 90, 101, 110):
        for start in range(0, 400 - size, 3):
            quote = item[start : start + size].strip().ljust(size, "x")
            whole = quote == item[start : start + size]
            for edits in (0, 6):
                spoilt = quote if not edits else quote[:8] + "Ω" + quote[9 : size - 30] + "ΩΩΩΩΩ" + quote[size - 25 :]
                if whole:
                    assert index.contains_any("zzz " + spoilt + " zzz"), (size, start, edits)


def test_every_occurrence_is_a_passage():
    draw = random.Random(3)
    items = [(i, "".join(draw.choices(LETTERS, k=150))) for i in range(3)]
    noise = "".join(draw.choices(LETTERS, k=300))
    text = items[1][1] + noise + items[0][1][20:140] + noise + items[1][1].upper()
    got = Index(items).hits(text)
    assert [r[0] for r in got] == [0, 1, 1]
    assert [normalised(text[s:e])[0].tolist() for _, s, e, _, _ in got[1:]] == [normalised(items[1][1])[0].tolist()] * 2
    # Windows of other scripts and blanks are levelled too.
    upper = "ΑΒΓΔΕ ЖЗИЙК ԱԲԳԴ Ａｂｃ " * 6
    assert Index([(7, upper)]).contains_any(upper.lower().replace(" ", "\u3000"))


def test_common_lines_are_counted_in_parts(monkeypatch):
    draw = random.Random(5)
    line = "".join(draw.choices(LETTERS, k=60))
    items = [(i, line + "".join(draw.choices(LETTERS, k=90))) for i in range(40)]
    text = "".join(draw.choices(LETTERS, k=50)) + items[17][1] + line
    want = Index(items).hits(text)
    monkeypatch.setattr(D, "HITS", 100)
    assert Index(items).hits(text) == want and {r[0] for r in want} == {17}


def test_pieces_lose_nothing(monkeypatch):
    draw = random.Random(8)
    text = "".join(draw.choices(LETTERS, k=130))
    index = Index([(1, text)])
    monkeypatch.setattr(D, "PIECE", 50)
    for shift in range(0, 120, 7):
        codes = normalised("q" * shift + text + "z" * 300)[0]
        assert {at for _, at, *_ in index.regions(codes)} == {at for _, at, *_ in windows(index)}


def test_documents_and_places(spark):
    draw = random.Random(2)
    items = [(i, "".join(draw.choices(LETTERS, k=100))) for i in range(5)]
    benchmark = spark.createDataFrame([*items, (9, "short"), (10, None)], "item_id long, text string")
    clean = [(i, "".join(draw.choices(LETTERS, k=400))) for i in range(100, 140)]
    text = f"É  before\n\n{items[3][1].upper()}  and\tbehind"
    rows = [*ODD, *clean, (200, text), (201, items[0][1]), (None, items[0][1])]
    docs = documents(spark, rows)
    got = find_passages(docs, benchmark).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("200", 3), ("201", 0), ("None", 0)]
    place = next(r for r in got if r.doc_id == 200)
    assert " ".join(text[place.start : place.end].lower().split()) == " ".join(items[3][1].split())
    assert place.edits == 0
    out = decontaminate(docs, benchmark)
    assert out.schema == docs.schema and out.count() == len(rows) - 3
    assert find_passages(documents(spark, []), benchmark).count() == 0
    assert find_passages(docs, benchmark.limit(0)).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    draw = random.Random(6)
    items = [(i, "".join(draw.choices(LETTERS, k=120))) for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, f"start {text} end") for i, text in items])
    monkeypatch.setattr(D, "BLOCK_CHARS", 1_000)
    got = find_passages(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in items]
    assert decontaminate(docs, benchmark).count() == 0
