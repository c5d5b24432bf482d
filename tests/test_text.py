import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.text import SLICE_BYTES, normalize_markdown, normalize_text
from tessera.operators.chunk import CHUNKERS, SEPARATORS, Splitter, splitter_udf
from tessera.plans import catalog

TEXT = st.text(alphabet="ab .,\n#;é漢", max_size=300)


@given(TEXT, st.integers(2, 40), st.sampled_from(sorted(SEPARATORS)), st.booleans())
@settings(max_examples=300, deadline=None)
def test_chunks_without_overlap_join_to_the_text(text, size, name, lead):
    got = Splitter(size, 0, SEPARATORS[name], lead).split(text)
    assert all(0 < len(c) <= size for c in got)
    assert "".join(got) == (text if text.strip() else "")


@given(TEXT, st.integers(5, 40), st.sampled_from(sorted(SEPARATORS)))
@settings(max_examples=200, deadline=None)
def test_chunks_with_overlap_keep_order(text, size, name):
    at = 0
    for c in Splitter(size, size // 3, SEPARATORS[name]).split(text):
        assert 0 < len(c) <= size
        assert (at := text.find(c, max(0, at - size))) >= 0


def test_overlap_repeats_whole_pieces():
    assert Splitter(12, 6, (" ", "")).split("aaaa bbbb cccc dddd") == ["aaaa bbbb ", "bbbb cccc ", "cccc dddd"]


def test_characters_have_no_overlap():
    assert Splitter(4, 2, (" ",)).split("a" * 10) == ["aaaa", "aaaa", "aa"]


def test_separator_dropped_counts_in_length():
    assert Splitter(5, 0, ("|", ""), keep=False).split("ab|cd|ef") == ["ab|cd", "ef"]


def test_heading_gets_a_newline():
    assert CHUNKERS["mdx"].split("# A\ntext") == ["\n# A\ntext"]


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        Splitter(size, overlap)


def test_blank_gives_nothing():
    assert Splitter().split("  \n\x1c") == [] == Splitter().split(None)


def test_normalize():
    assert normalize_text("﻿é\r\na \x00b \t\r\n\n\n\n c\n\n") == "é\na b\n\n c"
    code = "```py\nx   \n\n\ny\n```"
    assert normalize_text(code + "   \n") == code + "   "
    assert normalize_text(None) is None


@given(st.text(alphabet="a \t\n\r`~ ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_normalize_is_idempotent(text):
    once = normalize_text(text)
    assert normalize_text(once) == once


#: Nulls and empty texts among long ones; one is longer than a slice.
LONG = [None, "", *(f"# é{n}  \n\n\n" + "word 漢\t\n" * 300 for n in range(900)), "x" * (SLICE_BYTES + 9), None]


def in_slices(function):
    """What a worker yields for one batch, and its texts by slice."""
    out = list(function(iter([pa.array(LONG[:1] + LONG).slice(1)])))
    ends = [sum(map(len, out[:n])) for n in range(len(out) + 1)]
    made = [sum(len((t or "").encode()) for t in LONG[a:b]) for a, b in zip(ends, ends[1:])]
    assert len(out) > 3 and ends[-1] == len(LONG) and all(n <= SLICE_BYTES or b - a == 1 for n, a, b in zip(made, ends, ends[1:]))
    return [x for part in out for x in part.to_pylist()]


def test_chunks_of_a_batch_are_made_slice_by_slice():
    assert in_slices(splitter_udf(CHUNKERS["text"]).func) == [CHUNKERS["text"].split(t) for t in LONG]


@pytest.mark.parametrize("name", ["chunk_maxlen", "chunk_reconstruct", "html_chunks"])
def test_texts_are_chunked_once(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_batch_is_normalized_slice_by_slice():
    assert in_slices(normalize_markdown.func) == [normalize_text(t) for t in LONG]
