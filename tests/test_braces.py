"""Commands with arguments over several lines against a plain reader; tokens of editors against a plain loop."""

from __future__ import annotations

import random

import pytest

from lumenkg.operators import braces as B
from lumenkg.operators.lint import MACROS

PIECES = ["\\symdecl", "\\sr", "\\importmodule", "\\foo", "{", "}", "{", "}", "[", "]", "\n", " ", "a", "x?y", "\\{", "\\}", "\\\\", "% {[\n", "\\%", "é"]


def plain(text: str) -> list[tuple]:
    """All known commands, read from the left."""
    n, at, live = len(text), 0, []
    while at < n:  # places of characters that count
        if text[at] == "\\":
            end = at + 1
            while end < n and text[end].isascii() and text[end].isalpha():
                end += 1
            end = end + (end < n and text[end] == "*") if end > at + 1 else min(at + 2, n)
            live.append((at, text[at:end]))
            at = end
        elif text[at] == "%":
            while at < n and text[at] != "\n":
                at += 1
        else:
            live.append((at, text[at]))
            at += 1

    def close(k: int) -> int | None:
        opener, depth = live[k][1], 0
        for j in range(k + 1, len(live)):
            c = live[j][1]
            if opener == "[" and depth == 0 and c == "]":
                return j
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    return j if opener == "{" else None
                depth -= 1
        return None

    def place(k: int) -> tuple[int, int]:
        before = text[:k]
        return before.count("\n"), k - (before.rfind("\n") + 1)

    out = []
    for k, (start, token) in enumerate(live):
        if token[0] != "\\" or token[1:] not in MACROS:
            continue
        option, args, last = None, [], k
        for mark in "[{[{{":
            j = last + 1
            while j < len(live) and live[j][1] in " \n":
                j += 1
            if j < len(live) and live[j][1] == mark and (mark == "{" or option is None) and (c := close(j)) is not None:
                inner = text[live[j][0] + 1 : live[c][0]]
                option, args, last = (inner if mark == "[" else option), args + ([inner] if mark == "{" else []), c
            elif mark == "{":
                break
        out.append((token[1:], *place(start), *place(live[last][0] + len(live[last][1])), option, tuple(args)))
    return out


def test_commands_of_random_texts(spark):
    rng = random.Random(4)
    texts = ["", None, "\\sr", "\\symdecl{a\n{b}\nc}[o[1]", "\\sr{a}{b", "\\sr {a}\n{b} tail}", "x" * 5000 + "\\sr{" + "y\n" * 2000 + "}"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    found = B.commands(spark.createDataFrame(list(enumerate(texts)), "file long, text string")).where("name not in ('begin', 'end')").collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: (r.file, r["at"])):
        got.setdefault(r.file, []).append((r.name, r.line, r.col, r.stop_line, r.stop_col, r.option, tuple(r["args"])))
    for k, text in enumerate(texts):
        assert got.get(k, []) == plain(text or ""), text


def test_environments_and_balance(spark):
    text = "\\begin{smodule}{a}\n\\begin{sdefinition}\n\\begin{smodule}{b} \\symdecl{x} \\end{smodule}\n\\sr{x}{} \\end{sdefinition}\n\\end{smodule}\\begin{sparagraph}\n\\sr{b?x}{} } {"
    df = spark.createDataFrame([(1, text)], "file long, text string")
    found = B.commands(df)
    envs = B.environments(found)
    assert sorted((r.name, r.line, r.stop_line, r.level) for r in envs.where("close is not null").collect()) == [("sdefinition", 1, 3, 2), ("smodule", 0, 4, 1), ("smodule", 2, 2, 3)]
    assert [r.name for r in envs.where("close is null").collect()] == ["sparagraph"]
    inside = B.within(found, envs, "module")
    assert sorted((r.name, r.line, r.inside) for r in inside.where("kind in ('symbol', 'reference')").collect()) == [("sr", 3, "a"), ("sr", 5, None), ("symdecl", 2, "b")]
    assert sorted((r.symbol, r.def_line) for r in B.references(found, inside).collect()) == [("b?x", 2), ("x", 2)]
    assert sorted((r.line, r.message) for r in B.unbalanced(df).collect()) == [(5, "closes nothing"), (5, "not closed")]


@pytest.mark.parametrize("seed", range(3))
def test_tokens_are_skipped(spark, seed):
    rng = random.Random(seed)
    rows = [(f, n, (line := rng.randrange(5)), rng.randrange(9), line + rng.choice([0, 0, 1]), rng.randrange(12), "t") for f in range(4) for n in range(12)]
    want = []
    for f in range(4):
        at = (0, 0)
        for _, n, line, col, stop_line, stop_col, _ in (r for r in rows if r[0] == f):
            if (line, col) > at:
                want.append((f, n, line - at[0], col - at[1] if line == at[0] else col, stop_col - col if line == stop_line and stop_col >= col else 999))
                at = (line, col)
    got = B.semantic_tokens(spark.createDataFrame(rows, "file int, nth int, line int, col int, stop_line int, stop_col int, type string").repartition(3))
    assert sorted((r.file, r.nth, r.d_line, r.d_col, r.length) for r in got.collect()) == want


def test_tokens_are_not_shuffled(spark, monkeypatch):
    """Commands are found where a source lies: one table is written, of commands."""
    from lumenkg.operators import braces

    names = []
    monkeypatch.setattr(braces, "stored", lambda df, name: names.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange"))) or df)
    assert B.commands(spark.createDataFrame([(1, "\\sr{a}")], "file long, text string")).count() == 1
    assert names == [("commands", 0)]
