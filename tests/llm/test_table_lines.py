"""Lines of prose that end in pipes are no tables."""

import pytest

from commitlake.llm import langid


def words(text):
    return [s[2] for s in langid.prose_sentences(text)]


@pytest.mark.parametrize("debris", [" \t\t\t|\t|", "|", " | | |  ", " |\t"])
def test_prose_before_pipes(debris):
    text = f"The nightly run trusts the clock{debris}\nof the host too much. Nobody knows why.{debris}\n\n* one item here{debris}"
    assert words(text) == [["The", "nightly", "run", "trusts", "the", "clock", "of", "the", "host", "too", "much"], ["Nobody", "knows", "why"], ["one", "item", "here"]]
    for start, end, found, _ in langid.prose_sentences(text):
        assert text[start:].startswith(found[0]) and found[-1] in text[start:end]


def test_marks_with_pipes_are_no_cells():
    assert words("<|startoftext|>The merge step reads `a | b` twice. \t\t\t|\t|") == [["The", "merge", "step", "reads", "twice"]]


@pytest.mark.parametrize("text", ["some name | some value |", "  | some name | some value", "| a name |", "name | value | \t|", "Fixes: abc \t|", "Co-Authored-By: Some One <a@b.example> \t\t|\t|", "- [x] `tests/a/b.go` \t\t|\t|", "-----|"])
def test_tables_and_trailers(text):
    assert words(text) == []
