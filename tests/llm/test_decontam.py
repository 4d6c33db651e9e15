"""Template decontamination: other values of one template leak, mixed-up values do not."""

from assay.llm.decontam import leaks
from tests.llm.frames import ODD, documents

ITEM = "A train leaves from Paris at 9 and needs 120 km to reach Lyon while Anna waits 45 minutes in Lyon for it today."


def found(spark, docs, items=((1, ITEM),), **settings):
    benchmark = spark.createDataFrame(list(items), "item_id bigint, text string").selectExpr("*", "'x' AS hash", "'x' AS item")
    rows = leaks(documents(spark, docs), benchmark, **settings).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_copies_and_templates_leak(spark):
    other = ITEM.replace("Paris", "Berlin").replace("Lyon", "Bonn").replace("Anna", "Otto").replace("120 km", "77.5 miles")
    docs = [
        (1, "Before it. " + ITEM + " After it."), (2, other), (3, ITEM.replace("reach Lyon", "reach Nice")),
        (4, "A train leaves from a village at dawn and needs a day to reach the sea."), (5, ITEM[: len(ITEM) // 2]),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1].consistent and got[2, 1].consistent and got[2, 1].n_slots > 0
    assert not got[3, 1].consistent  # two names stand for one
    assert got[1, 1].first_word == 2 and got[1, 1].n_found == got[1, 1].n_windows


def test_odd_rows(spark):
    items = [(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, "one two three four five six seven"), (5, "12 13 14 15 16 17 18")]
    got = found(spark, ODD, items)
    assert set(got) == {(1, None), (8, None)}
    assert found(spark, []) == {} and found(spark, ODD, []) == {}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    import assay.llm.decontam as D

    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, [(1, ITEM), (2, "nothing of it here, at all, whatever")])) == {(1, 1)}


def test_every_occurrence_is_judged_by_itself(spark):
    twice = "Tom has 3 red apples in all and then Ann has 5 red apples in all today."
    keeps = "In the old shop she keeps 30 boxes of apples for long winters and sells 12 of them each day to Anna, who likes the red ones most and eats them all before the sun is up."
    items = ((1, twice), (2, keeps))
    mixed = keeps.replace("12", "7").replace("30", "50")
    torn = keeps.replace("sells", "then after a very long and cold night of rain sells")
    docs = [
        (1, twice), (2, twice.replace("3", "8").replace("5", "9")),
        (3, "They said she keeps 7 boxes of apples for long. " + keeps), (4, "So she keeps 7 boxes of apples for long. " + mixed),
        (5, "So she keeps 7 boxes of apples for long. " + torn), (6, keeps),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)}
    assert {k: r.consistent for k, r in got.items()} == dict.fromkeys(got, True)
    assert got[1, 1].n_found == got[1, 1].n_windows and got[3, 2].n_found == got[3, 2].n_windows
    assert got[3, 2].first_word == 10 + got[6, 2].first_word


def test_no_occurrence_is_consistent(spark):
    item = "Anna has 3 red apples at home and then gives 3 green apples to her friends and 4 to Otto."
    bad = item.replace("3 green", "8 green")
    got = found(spark, [(1, bad + " " + bad), (2, bad), (2, "It has 3 red apples at home. " + item), (None, "Why has 5 red apples at home? " + item)], ((1, item),))
    assert {k: r.consistent for k, r in got.items()} == {(1, 1): False, (2, 1): True, (None, 1): True}
