import re

import pytest

from tidemark.llm import decontam
from tidemark.llm.decontam import contaminated, op8_template_decontamination

ITEM = "A train leaves Boston at 9 and travels 120 km to Albany. How many hours will the train from Boston need at 60 km?"
OTHER = "Zu welcher Temperatur muss man das Wasser im Topf bringen damit die Eier in 8 Minuten gar sind?"
SHORT = "What is seven plus eight"
FILL = "nothing of that kind stands in this long line of words, "


def found(spark, docs, items=((1, ITEM), (2, OTHER), (3, SHORT), (4, None), (5, "a b"))):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item string, pos int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc int")
    return {(r.doc, r.item): r for r in contaminated(d, b).collect()}


def test_verbatim_and_reparameterised(spark):
    swapped = ITEM.replace("Boston", "Denver").replace("Albany", "Aspen").replace("120", "300").replace("9", "11").replace("60 km", "75 miles").replace("km", "miles")
    mixed = ITEM.replace("Boston", "Denver", 1).replace("120", "300")
    got = found(spark, [(1, FILL + ITEM + " " + FILL), (2, FILL * 3 + swapped), (3, mixed), (4, FILL * 9), (5, OTHER.upper().replace("8", "8")),
                        (6, FILL + "what is seven plus eight? " + FILL), (7, None), (8, ""), (9, "A train leaves Boston at 9 and stops.")])
    assert got[1, 1].kind == "verbatim" and got[2, 1].kind == "reparameterised" and got[2, 1].changed >= 4
    assert (3, 1) not in got  # Boston is Denver once and Boston once
    assert got[6, 3].kind == "verbatim"
    assert not {4, 7, 8, 9} & {d for d, _ in got}


def test_case_and_punctuation(spark):
    got = found(spark, [(1, FILL + re.sub("[.?]", " --", OTHER) + FILL)])
    assert got[1, 2].kind == "verbatim"


def test_items_of_few_plain_words(spark):
    items = ["What is 12 + 7 * 3 - 4 / 2 + 9 * 8 - 6 + 15 * 2?", "Evaluate 3 + 5 * 2 - 8 / 4 + 7 * 6",
             "Who was older when Apollo 11 landed in 1969: Neil Armstrong or Buzz Aldrin, Michael Collins or Gene Kranz?"]
    pairs = [*enumerate(items)]
    docs = [(i, FILL + x + " " + FILL) for i, x in pairs] + [(10 + i, FILL + x.lower()) for i, x in pairs]
    # Other numbers and names are other questions: nothing but placeholders is left of these windows.
    docs += [(20, FILL + items[0].replace("1", "5").replace("7", "6").replace("9", "4")), (21, FILL + "Evaluate 4 + 9 * 3 - 7 / 5 + 2 * 8")]
    got = found(spark, docs, pairs)
    assert set(got) == {(i, i) for i in range(3)} | {(10 + i, i) for i in range(3)}
    assert {x.kind for x in got.values()} == {"verbatim"}


def test_long_literal_run_beside_an_altered_name(spark):
    item = ("In the morning the old farmer Boston walked over to the market and sold four baskets of apples for two coins each, "
            "then he bought some bread for the family and went home again, so how many coins did farmer Boston still have left?")
    altered = item.replace("Boston", "Denver", 1)
    got = found(spark, [(1, FILL + altered + " " + FILL), (2, FILL + item)], [(1, item)])
    assert set(got) == {(1, 1), (2, 1)}
    words = lambda t: len(re.findall(r"[^\W_]+", t))
    start = words(FILL + altered[: altered.index("Denver") + 6])
    assert (got[1, 1].first_token, got[1, 1].last_token) == (start, words(FILL + altered) - 1)
    assert (got[1, 1].kind, got[1, 1].changed) == ("verbatim", 0)
    assert got[1, 1].n_windows == got[1, 1].last_token - start + 1 - 7


def test_repeated_rows_and_ties(spark):
    got = found(spark, [(1, ITEM + " " + ITEM), (1, ITEM), (None, ITEM), (2, ("word " * 60000) + ITEM)], [(1, ITEM), (7, ITEM), (None, ITEM)])
    assert set(got) == {(1, 1), (1, 7), (2, 1), (2, 7)}
    assert got[1, 1].first_token == 0


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", -1)
    assert set(found(spark, [(1, FILL + ITEM), (2, FILL)])) == {(1, 1)}


def test_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, [(1, ITEM)], []) == {}


@pytest.mark.parametrize("sf", ["0.001"])
def test_whole_items_in_documents(spark, sf):
    """Every item that stands in a document as it is, and no document without a long common run of words."""
    import duckdb

    folder = f"/root/testdata/sf{sf}"
    result = op8_template_decontamination(spark, folder)
    assert not re.search("Python|Arrow|Pandas", result._jdf.queryExecution().toString())
    got = {(r.doc_id, r.item_id) for r in result.collect()}
    sql = f"SELECT doc_id, item_id, d.text, b.text FROM '{folder}/documents.parquet' d, '{folder}/benchmark.parquet' b"
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda w: {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
    seen = {}
    for doc, item, text, question in duckdb.sql(sql).fetchall():
        if question in text:
            assert (doc, item) in got
        elif (doc, item) in got:
            seen.setdefault(doc, runs(words(text)))
            assert len(seen[doc] & runs(words(question))) >= 4
