from quillspark.operators import shred

DDL = (
    "rec_id bigint, detailed_sections array<struct<section_title:string,content:string,key_details:array<string>>>, "
    "penalties_and_consequences array<struct<violation:string,penalty:string,amount:string,conditions:string>>, "
    "important_entities struct<people:array<string>,organizations:array<string>,locations:array<string>,amounts:array<string>,dates:array<string>,references:array<string>>, node string, pos int, label string"
)


def nodes(spark, rows):
    return shred.adjacency(spark.createDataFrame(rows, DDL))


def tables(spark, rows):
    return shred.entity_tables(nodes(spark, rows))


def test_links_and_nulls(spark):
    rows = [
        (1, [None, ("t", None, ["a", None, "", "a"]), (None, None, None), (None, None, [])], [(None,) * 4, ("v", None, None, None)], (["x", "x", " "], None, [], None, None, [None]), "n", 1, "l"),
        (2, None, None, None, "n", 1, "l"),
        (3, [], [], (None,) * 6, "n", 1, "l"),
    ]
    t = tables(spark, rows)
    assert sorted((r.rec_id, r.pos, r.section_title) for r in t["sections"].collect()) == [(1, 1, "t"), (1, 3, None)]
    assert sorted((r.parent, r.pos, r.value) for r in t["key_details"].collect()) == [("detailed_sections[1]", 0, "a"), ("detailed_sections[1]", 2, ""), ("detailed_sections[1]", 3, "a")]
    assert [(r.pos, r.violation) for r in t["penalties"].collect()] == [(1, "v")]
    assert sorted((r.kind, r.pos, r.value) for r in t["entities"].collect()) == [("people", 0, "x"), ("people", 1, "x"), ("people", 2, " ")]
    assert shred.elements(nodes(spark, rows)).count() == 2 + 3 + 1 + 3
    # every child's parent is there
    assert t["key_details"].join(t["sections"], (t["key_details"].parent == t["sections"].node), "left_anti").count() == 0


def test_repeated_rows_and_empty(spark):
    row = (1, [("t", "c", ["k"])], None, None, "n", 1, "l")
    assert shred.elements(nodes(spark, [row, row])).count() == 2
    assert shred.elements(nodes(spark, [])).count() == 0
    assert shred.elements(nodes(spark, [(None, *row[1:])])).count() == 2
