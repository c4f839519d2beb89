import hashlib
import re

import pytest

from stintlake.llm import decontamination

from .helpers import LONG, ODD, docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans(decontamination.UPPER, decontamination.LOWER)


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def brute(rows, items):
    out = []
    wins = {(i, tuple(ws[at : at + 10])) for i, t in items if i is not None and (ws := words(t)) for at in range(max(len(ws) - 10, 0) + 1)}
    for doc_id, text in rows:
        ws, hit, ids = words(text), set(), set()
        places = {}
        for at, w in enumerate(ws):
            places.setdefault(w, []).append(at)
        for item, win in wins:
            for at in places.get(win[0], ()):
                if tuple(ws[at : at + len(win)]) == win:
                    hit.update(range(at, at + len(win)))
                    ids.add(str(item))
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


PASSAGE = "Alpha beta, GAMMA delta: épsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [(1, PASSAGE), (10, "alpha BETA gamma delta épsilon zeta eta theta iota kappa"), (2, "the the the the the the the the the the the"), (3, "one"), (4, "two words"), (5, "東京 😀 x"), (6, None), (7, " !? "), (None, "no id here at all"), (8, PASSAGE.upper()), (8, "a second row of item eight"), (9, LONG[:400])]
SPLIT = PASSAGE.replace(" eta ", " eta other ")
DOCS = ODD + [(20, f"before {PASSAGE} after {PASSAGE}"), (21, SPLIT), (22, " ".join(["the"] * 25)), (23, " ".join(["The"] * 9)), (24, "two-words ONE two, WORDS"), (25, PASSAGE[:-10] + "."), (26, PASSAGE.replace("É", "é").replace("é", "É")), (27, "東京,😀 X"), (28, "\x00alpha\x7fbeta")]
DOCS += [(100 + i, f"{i} filler {PASSAGE} tail {i}") for i in range(60)]  # a passage that most documents share


@pytest.mark.parametrize("limit", [200_000, 0])
def test_equals_brute_force(spark, limit):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, pos int").repartition(2)
    frame = docs(spark, DOCS).selectExpr("*", "1 AS pos", "'q' AS sid", "2 AS w", "0 AS wid")
    got = decontamination.contaminated(frame, items, limit=limit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(DOCS, ITEMS)))


def test_without_items_or_documents(spark):
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    assert decontamination.contaminated(docs(spark, []), items).count() == 0
    none = decontamination.contaminated(docs(spark, DOCS), items.filter("item_id IN (6, 7)"))
    assert sorted(map(str, map(tuple, none.collect()))) == sorted(map(str, brute(DOCS, [])))
    assert none.dtypes == decontamination.contaminated(docs(spark, DOCS), items).dtypes


def test_prefixes_are_the_rarest_shingles(spark):
    """A window is looked for at its rarest shingle only, and not at all if a document has none of one."""
    items = spark.createDataFrame([(1, "a b c d e"), (2, "a b c q r")], "item_id long, text string")
    frame = docs(spark, [(1, "a b c d e"), (2, "a b c x a b c y"), (3, "b c d a b c")])
    of = decontamination.windows(items, 10)
    numbered = of.selectExpr("window", "w", "CASE WHEN array_contains(window, 'q') THEN 2L ELSE 1L END AS wid")
    each = numbered.select("wid", "w", decontamination.F.posexplode(decontamination.shingles_of("window", 3)).alias("i", "shingle"))
    shingles = each.selectExpr("shingle", "xxhash64(shingle) AS sid").distinct()
    hits = decontamination.placed(frame, shingles, [3], 100)
    found = decontamination.occurrences(hits, each.selectExpr("wid", "w", "i", "xxhash64(shingle) AS sid"), 100).collect()
    assert [(r["wid"], r["start"], r["w"]) for r in found] == [(1, 0, 5)]
