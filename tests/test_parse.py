import pytest

from colloquy.operators import parse


def parsed(spark, f, text):
    found = f(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("ord").collect()
    return [(r["speaker"], r["content"], r["start_time"], r["end_time"]) for r in found]


def test_labelled(spark):
    found = parsed(spark, parse.parse_labelled, "Alice: Hello, how are you?\nBob: I'm fine, thanks!")
    assert [x[:2] for x in found] == [("Alice", "Hello, how are you?"), ("Bob", "I'm fine, thanks!")]
    assert found[0][2] == 0.0
    assert found[1][2] == found[0][3]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A: First.\n\nB: Second.\n\nC: Third.", [("A", "First."), ("B", "Second."), ("C", "Third.")]),
        ("갑: 안녕하세요.\n\n을: 반갑습니다.", [("갑", "안녕하세요."), ("을", "반갑습니다.")]),
        ("Hello, World!\n\nThis is\n a test.", [("unknown", "Hello, World!"), ("unknown", "This is a test.")]),
        ("preamble\nA: x\n\ndropped", [("A", "x")]),
        ("", []),
        ("\n \n", []),
        (None, []),
    ],
)
def test_turns_and_paragraphs(spark, text, expected):
    assert [x[:2] for x in parsed(spark, parse.parse_labelled, text)] == expected


def test_durations(spark):
    found = parsed(spark, parse.parse_labelled, "A: hi\nB: " + "x" * 750)
    assert [(x[2], x[3]) for x in found] == [(0.0, 0.5), (0.5, 60.5)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("[00:00:05] Alice: Hello!\n[00:00:10] Bob: Hi there!", [("Alice", "Hello!", 5.0), ("Bob", "Hi there!", 10.0)]),
        ("[01:30:00] Speaker: late", [("Speaker", "late", 5400.0)]),
        ("(05:30) Speaker: soon", [("Speaker", "soon", 330.0)]),
        ("[00:10] no label", [("unknown", "no label", 10.0)]),
        ("A: plain", [("A", "plain", 0.0)]),
    ],
)
def test_timestamped(spark, text, expected):
    assert [x[:3] for x in parsed(spark, parse.parse_timestamped, text)] == expected


def test_entry_ends_as_the_next_begins(spark):
    found = parsed(spark, parse.parse_timestamped, "[00:00:00] A: First.\n[00:00:10] B: Second.")
    assert found[0][3] == found[1][2] == 10.0


def test_long_line_without_colon_is_linear(spark):
    assert len(parsed(spark, parse.parse_labelled, "word " * 200_000)) == 1
