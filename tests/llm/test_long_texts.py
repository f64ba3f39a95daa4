"""Very long texts go through every operator in reasonable time."""

import time

from docweave.llm.language import Identifier, segments
from docweave.llm.leakage import words_of
import numpy as np

from docweave.llm.page_body import match_nodes, tree_of
from docweave.llm.pii import mentions
from docweave.llm.truncation import ending, open_at_end


def within(seconds, f, *args):
    began = time.perf_counter()
    out = f(*args)
    assert time.perf_counter() - began < seconds
    return out


def test_long_lines_and_many_lines():
    one_line = "The rig was held at 40 degrees while the work went on, " * 20_000
    many = "담당자는 임해담 교수이며 전화는 010-0123-4567입니다.\n" * 20_000
    wrapped = "words that never end\n" * 20_000
    spaces = "x" + " " * 200_000 + "y"
    brackets = "(" * 100_000 + "])" * 50_000
    ident = Identifier({"en": "The rig was held at some degrees while the work went on.", "ko": "담당자는 교수이며 전화는 입니다."})
    for text in (one_line, many, wrapped, spaces, brackets):
        within(20, mentions, text)
        within(20, tree_of, text)
        within(20, segments, text, ident)
        within(20, ending, text)
        within(20, words_of, text)
    assert len(within(20, mentions, many)) >= 40_000
    assert within(20, open_at_end, brackets)
    labels = np.arange(4_000) % 700
    assert len(within(20, match_nodes, (labels[:, None] == labels[None, :]).astype(np.float32))) == 4_000
