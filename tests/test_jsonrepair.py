import json

from quillspark.operators import jsonrepair as J


def test_parse_cascade():
    assert J.parse('{"a": 1}')[0] == J.PARSED
    assert J.parse('{"a": 1, "a": 2}')[1] == '{"a": 2}'
    assert J.parse('{"a": NaN}')[0] == J.PARSED
    assert J.parse('x {"a": 1} y')[0] == J.REPAIRED
    assert J.parse('x {"a": [1, 2,],} y')[0] == J.REPAIRED
    assert J.parse("x {} y")[0] == J.PARSED
    assert J.parse("{a: 'b'}") == (J.REPAIRED, '{"a": "b"}', None)
    assert J.parse("[1]")[0] == J.NOT_OBJECT and J.parse("null")[0] == J.NOT_OBJECT and J.parse("7")[0] == J.NOT_OBJECT
    assert J.parse("") == (J.FALLBACK, None, J.NO_STRUCTURE)
    assert J.parse("no braces")[2] == J.NO_STRUCTURE
    assert J.parse('{"a": http://x}')[2] == J.PARSE_FAILED


def test_balanced():
    assert J.balanced("} {a}") is None  # an early close shifts the depth
    assert J.balanced("x {a{b}} {c}") == "{a{b}}"
    assert J.balanced('{"a": "}"}') == '{"a": "}'  # not aware of strings
    assert J.balanced("{") is None


def test_replies(spark):
    rows = [(1, 0, "m", '```json\n{"document_info": {"title": "T"}}\n```'), (1, 1, "m", None), (2, 0, "m", '{"error": null}'), (3, 0, "m", "[1]"), (4, 0, "m", "prose"), (5, 0, "m", '{"penalties_and_consequences": {}, "document_info": {"title": "ok"}}')]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id int, chunk_no int, method string, response_text string, extra string")
    got = {(r.doc_id, r.chunk_no): r for r in J.typed(J.parse_replies(df)).collect()}
    assert got[1, 0].record.document_info.title == "T" and not got[1, 0].is_error
    assert got[1, 1].status is None
    assert got[2, 0].is_error and got[2, 0].record is None
    assert got[3, 0].is_error
    assert got[4, 0].record.document_info.title == J.FALLBACK_TITLE and got[4, 0].method_resolved == "m_fallback"
    assert got[5, 0].record.document_info.title == "ok"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, chunk_no int, method string, response_text string")
    assert J.typed(J.parse_replies(df)).count() == 0


def test_merge(spark):
    from quillspark.operators.merge import merge_chunks, pages_to_text

    def reply(**x):
        return json.dumps(x)

    rows = [
        (1, 2, "m", reply(document_info={"title": "B"}, main_content={"summary": "two", "key_points": ["k2", "k1"]}, important_entities={"people": ["b", "a"]}, full_text_content="y")),
        (1, 1, "m", reply(document_info={}, main_content={"purpose": "p", "summary": "one", "key_points": ["k1"]}, important_entities={"people": ["a"]}, full_text_content="x", action_items=["go", "go"])),
        (1, 3, "m", "[1]"),
        (2, 1, "m", '{"error": "blocked"}'),
    ]
    got = {r.doc_id: r for r in merge_chunks(J.typed(J.parse_replies(spark.createDataFrame(rows, "doc_id int, chunk_no int, method string, response_text string")))).collect()}
    one = got[1]
    assert one.document_info.title == "B" and one.main_content.purpose == "p" and one.main_content.summary == " one two"
    assert one.main_content.key_points == ["k1", "k2"] and one.important_entities.people == ["a", "b"]
    assert one.full_text_content == "\n\nx\n\ny" and one.action_items == ["go", "go"] and one.total_chunks == 3
    assert got[2].document_info is None and got[2].full_text_content == "" and got[2].total_chunks == 1
    pages = spark.createDataFrame([(1, 2, "b "), (1, 1, " a"), (1, 3, None)], "id int, n int, t string")
    assert pages_to_text(pages, "id", "n", "t").first().text == "a\nb"
