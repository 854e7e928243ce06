"""Code extraction from responses, as Column expressions (arrays of lines
and characters, higher-order functions; no UDF).

* fenced blocks: marker lines are paired 0-1, 2-3, ...; an odd last marker
  is dropped; blocks are joined with a blank line, or only the longest
  block (first wins ties) is kept;
* without at least two markers: stop-word truncation, then the python cut
  (first non-blank unindented line ends the code) or the brace cut (first
  point where the brace depth, starting at 1 -- 2 for java -- closes; else
  up to the last ``}``);
* check-program assembly: test prefix, language import header, python
  ``from __future__`` hoisting, then the test.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradewise.functions.text import as_col, let, occurrences

# ---------------------------------------------------------------- fixed values
# Fence markers.
MARKERS = ["```", "\\begin{code}", "\\end{code}"]

# Stop words per language, applied in this order.
STOP_WORDS = {
    "python": ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\nassert"],
    "go": ["\n//", "\nfunc main(", "struct", "\nfunc"],
}

# Languages cut at the closing brace, and their starting depth.
BRACE_START = {"java": 2, "javascript": 1, "go": 1, "cpp": 1, "rust": 1}

# Import headers prepended to the program (python, cpp and r only).
IMPORT_HEADER = {
    "python": [
        "import math",
        "import re",
        "import sys",
        "import copy",
        "import datetime",
        "import itertools",
        "import collections",
        "import heapq",
        "import statistics",
        "import functools",
        "import hashlib",
        "import numpy",
        "import numpy as np",
        "import pandas as pd",
        "import string",
        "import requests",
        "import openpyxl",
        "import xlsxwriter",
        "import yolk",
        "from typing import *",
        "from collections import *",
    ],
    "cpp": [
        "using namespace std;",
        "#include<stdlib.h>",
        "#include<algorithm>",
        "#include<cmath>",
        "#include<math.h>",
        "#include<numeric>",
        "#include<stdio.h>",
        "#include<vector>",
        "#include<set>",
        "#include<map>",
        "#include<queue>",
        "#include<stack>",
        "#include<list>",
        "#include<deque>",
        "#include<boost/any.hpp>",
        "#include<string>",
        "#include<climits>",
        "#include<cstring>",
        "#include<iostream>",
        "#include<sstream>",
        "#include<fstream>",
    ],
    "r": [
        "rm(list=ls())",
        "library(assert)",
    ],
}
# ------------------------------------------------------------ end fixed values

# Python's str.strip() whitespace, ASCII part.
WS = " \t\n\x0b\x0c\r"
NONBLANK = "[^ \\t\\n\\x0B\\f\\r]"


def marker_count(text) -> Column:
    t = as_col(text)
    total = occurrences(t, MARKERS[0])
    for m in MARKERS[1:]:
        total = total + occurrences(t, m)
    return total


def _is_fence(line: Column) -> Column:
    c = F.contains(line, F.lit(MARKERS[0]))
    for m in MARKERS[1:]:
        c = c | F.contains(line, F.lit(m))
    return c


def _lines(text) -> Column:
    return F.split(as_col(text), "\n", -1)


def _fence_pairs(lines: Column) -> Column:
    """array<struct<a, b>> of paired marker line numbers (0-based)."""
    idx = F.filter(F.transform(lines, lambda l, i: F.when(_is_fence(l), i)), lambda x: x.isNotNull())
    nxt = F.slice(idx, 2, 1 << 30)
    zipped = F.zip_with(idx, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    tagged = F.transform(zipped, lambda p, i: F.when((i % 2 == 0) & p["b"].isNotNull(), p))
    return F.filter(tagged, lambda p: p.isNotNull())


def _block(lines: Column, p: Column) -> Column:
    return F.array_join(F.slice(lines, p["a"] + 2, p["b"] - p["a"] - 1), "\n")


def fenced_code(text, only_longest=False) -> Column:
    """Code inside fences (caller checks ``marker_count >= 2``)."""
    return let(_lines(text), lambda lines: _fenced(lines, only_longest))


def _fenced(lines: Column, only_longest: bool) -> Column:
    pairs = _fence_pairs(lines)
    if not only_longest:
        return F.array_join(F.transform(pairs, lambda p: _block(lines, p)), "\n\n")
    ranked = F.transform(pairs, lambda p, i: F.struct((p["b"] - p["a"]).alias("n"), (-i).alias("neg_i"),
                                                     p["a"].alias("a"), p["b"].alias("b")))
    best = F.array_max(ranked)
    return F.when(F.size(pairs) > 0, _block(lines, best)).otherwise(F.lit(""))


def _cut_at(acc: Column, w: Column) -> Column:
    pos = F.instr(acc, w)
    return F.when(pos > 0, F.substring(acc, F.lit(1), pos - 1)).otherwise(acc)


def stop_word_cut(code, lang: Column) -> Column:
    """Cut at each stop word of the language in list order (a fold)."""
    def body(c):
        out = c
        for lg, words in STOP_WORDS.items():
            cut = F.aggregate(F.array(*[F.lit(w) for w in words]), c, _cut_at)
            out = F.when(lang == lg, cut).otherwise(out)
        return out
    return let(code, body)


def python_cut(code) -> Column:
    """Keep lines before the first non-blank line starting without indent."""
    return let(code, _python_cut)


def _python_cut(code) -> Column:
    lines = _lines(code)
    hits = F.filter(F.transform(lines, lambda l, i: F.when(
        F.regexp_like(l, F.lit(NONBLANK)) & ~F.substring(l, 1, 1).isin(" ", "\t"), i)),
        lambda x: x.isNotNull())
    first = F.element_at(hits, 1)
    return F.when(F.size(hits) > 0, F.array_join(F.slice(lines, 1, first), "\n")).otherwise(as_col(code))


def _last_brace_cut(c: Column) -> Column:
    return let(c, _last_brace_cut1)


def _last_brace_cut1(c: Column) -> Column:
    pos = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when(F.instr(c, "}") > 0, F.substring(c, F.lit(1), pos)).otherwise(c)


def brace_cut(code, start_depth: Column, is_java: Column) -> Column:
    """Cut where the running brace depth first reaches 0."""
    return let(code, lambda c: _brace_cut(c, start_depth, is_java))


def _brace_cut(c: Column, start_depth: Column, is_java: Column) -> Column:
    # The depth changes at braces alone: a piece runs up to its brace (the last has none).
    pieces = F.split(c, "(?<=[{}])", -1)
    at_once = (start_depth == 0) & ~F.regexp_like(c, F.lit("^[{}]"))
    init = F.struct(start_depth.cast("int").alias("d"), F.lit(0).alias("i"), F.when(at_once, 0).otherwise(-1).alias("cut"))

    def step(acc, piece):
        d = acc["d"] + F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
        i = acc["i"] + F.length(piece)
        cut = F.when((acc["cut"] < 0) & (d == 0), i - 1).otherwise(acc["cut"])
        return F.struct(d.alias("d"), i.alias("i"), cut.alias("cut"))

    cut = F.aggregate(pieces, init, step)["cut"]
    main_pos = F.instr(c, "public static void main")
    j = F.when(main_pos > 0, F.concat(F.substring(c, F.lit(1), main_pos - 1), F.lit("}"))).otherwise(c)
    j = let(_last_brace_cut(j), lambda v: F.when(occurrences(v, "{") - 1 == occurrences(v, "}"),
                                                 F.concat(v, F.lit("\n}"))).otherwise(v))
    fallback = F.when(is_java, j).otherwise(_last_brace_cut(c))
    return F.when(cut >= 0, F.substring(c, F.lit(1), cut + 1)).otherwise(fallback)


def remove_last_block(code, lang) -> Column:
    """Signature-form cleanup for responses without fences."""
    lang = as_col(lang)
    return let(stop_word_cut(code, lang), lambda c: _remove_last_block(c, lang))


def _remove_last_block(c: Column, lang: Column) -> Column:
    start = F.lit(None).cast("int")
    for lg, d in BRACE_START.items():
        start = F.when(lang == lg, F.lit(d)).otherwise(start)
    return (F.when(lang == "python", python_cut(c))
            .when(start.isNotNull(), brace_cut(c, start, lang == "java"))
            .otherwise(c))


def extract_code(text, lang, only_longest=False) -> Column:
    """Code of a response: fenced blocks when there are two markers, else
    the signature-form cleanup."""
    return let(text, lambda t: F.when(marker_count(t) >= 2, fenced_code(t, only_longest))
               .otherwise(remove_last_block(t, lang)))


def py_strip(text) -> Column:
    """Python ``str.strip()`` (ASCII whitespace)."""
    return F.regexp_replace(as_col(text), "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")


def hoist_future(program) -> Column:
    """Move ``from __future__`` lines to the top, order kept otherwise."""
    return let(_lines(program), _hoist)


def _hoist(lines: Column) -> Column:
    fut = F.filter(lines, lambda l: F.startswith(l, F.lit("from __future__")))
    rest = F.filter(lines, lambda l: ~F.startswith(l, F.lit("from __future__")))
    return F.array_join(F.concat(fut, rest), "\n")


def with_header(code, lang) -> Column:
    """Import header of the language; python also hoists __future__ lines."""
    lang = as_col(lang)
    return let(code, lambda c: _with_header(c, lang))


def _with_header(c: Column, lang: Column) -> Column:
    out = c
    for lg, lines in IMPORT_HEADER.items():
        h = py_strip(F.concat(F.lit("\n".join(lines) + "\n"), c))
        if lg == "python":
            h = hoist_future(h)
        out = F.when(lang == lg, h).otherwise(out)
    return out


def check_program(response, lang, test, prefix=None, file_prefix=None, only_longest=False) -> Column:
    """Full program handed to the sandbox: ``prefix\\nresponse`` -> code
    extraction -> ``file_prefix\\n`` -> header -> ``\\n`` + test."""
    prefix = F.lit("") if prefix is None else as_col(prefix)
    file_prefix = F.lit("") if file_prefix is None else as_col(file_prefix)
    combined = F.concat(prefix, F.lit("\n"), as_col(response))
    code = F.concat(file_prefix, F.lit("\n"), extract_code(combined, lang, only_longest))
    return F.concat(with_header(code, lang), F.lit("\n"), as_col(test))
