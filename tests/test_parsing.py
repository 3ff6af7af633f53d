import pytest

from lexiloom.operators.parsing import basic, parse, plain, stemmed

CASES = [
    ("python", [], ["python"], [], [], []),
    ("python java", [], ["python", "java"], [], [], []),
    ("python AND kubernetes", ["python", "kubernet"], [], [], [], []),
    ("docker AND linux AND python", ["docker", "linux", "python"], [], [], [], []),
    ("engineer AND python NOT google", ["engin", "python"], [], ["googl"], [], []),
    ("docker OR linux", [], ["docker", "linux"], [], [], []),
    ("python NOT kubernetes", [], ["python"], ["kubernet"], [], []),
    ("salt and pepper", [], ["salt", "pepper"], [], [], []),
    ('"machine learning"', [], [], [], [["machin", "learn"]], []),
    ('NOT "machine learning"', [], [], [], [], [["machin", "learn"]]),
    ('not "machine learning"', [], [], [], [], [["machin", "learn"]]),
    ('python "machine learning"', [], ["python"], [], [["machin", "learn"]], []),
    ("a1 AND b1 OR c1", ["a1", "b1"], ["c1"], [], [], []),
    ("a1 OR b1 AND c1", ["c1"], ["a1", "b1"], [], [], []),
    ("x1 NOT y1 z1", [], ["x1"], ["y1", "z1"], [], []),
    ('""', [], [], [], [], []),
    ("", [], [], [], [], []),
    ("the a is", [], [], [], [], []),
]


@pytest.mark.parametrize("text,required,optional,excluded,phrases,excluded_phrases", CASES)
def test_parse(text, required, optional, excluded, phrases, excluded_phrases):
    q = parse(text)
    assert (q.required, q.optional, q.excluded, q.phrases, q.excluded_phrases) == (required, optional, excluded, phrases, excluded_phrases)


def test_searchable_and_augmentation():
    assert not parse("NOT x1").searchable and parse('"a1 b1"').searchable
    assert parse("a1 b1").may_augment and not parse("a1 NOT b1").may_augment


def test_tokens():
    assert stemmed("The Python Developers were Running Fast.") == ["python", "develop", "run", "fast"]
    assert plain("and or not !!! ??? ...") == []
    assert basic("Running the c++ café") == ["running", "the", "c", "caf"]
