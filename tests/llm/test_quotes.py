"""Quotation linking on hand-made threads and against a plain re-statement."""

import random
import re
import time

from terradrift.llm.quotes import _INTRODUCTION, link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    return {(r["conv_id"], r["turn"]): r.asDict() for r in df.collect()}


def test_nested_quotes_build_a_thread(frame):
    rows = [
        (1, 0, "user", "Where does the ferry leave?\nAnd at what time?"),
        (1, 1, "assistant", "On Monday U wrote:\n> Where does the ferry leave?\n> And at what time?\nFrom the north pier, at nine."),
        (1, 2, "user", "An unrelated question about bread and butter"),
        (1, 3, "user", "> > where   does the FERRY leave?\n> > And at what time?\n>\n> From the north pier, at nine.\n\nThank you, see you there."),
        (2, 0, "user", "> Where does the ferry leave?\nNot answered in this conversation"),
    ]
    got = result(link_quotes(frame(rows, SCHEMA)))
    assert got[1, 1]["own_text"] == "From the north pier, at nine."
    assert (got[1, 1]["parent_turn"], got[1, 1]["thread_turn"], got[1, 1]["reply_depth"]) == (0, 0, 1)
    assert (got[1, 3]["parent_turn"], got[1, 3]["thread_turn"], got[1, 3]["reply_depth"]) == (1, 0, 2)
    assert got[1, 3]["own_text"] == "Thank you, see you there."
    assert (got[1, 2]["parent_turn"], got[1, 2]["thread_turn"], got[1, 2]["reply_depth"]) == (None, 2, 0)
    assert (got[2, 0]["parent_turn"], got[2, 0]["n_quoted"], got[2, 0]["n_linked"]) == (None, 1, 0)
    order = sorted(got, key=lambda k: (k[0], got[k]["thread_turn"], k[1]))
    assert order == [(1, 0), (1, 1), (1, 3), (1, 2), (2, 0)]


def test_long_chain_reaches_its_root(frame):
    rows = [(1, 0, "a", "message number zero")]
    rows += [(1, i, "a", f"> message number {'zero' if i == 1 else i - 1}\nmessage number {i}") for i in range(1, 14)]
    got = result(link_quotes(frame(rows, SCHEMA)))
    assert [got[1, i]["reply_depth"] for i in range(14)] == list(range(14))
    assert {got[1, i]["thread_turn"] for i in range(14)} == {0}


def test_earliest_original_wins_and_later_ones_do_not_answer(frame):
    rows = [(1, t, "a", "the very same passage") for t in range(3)] + [(1, 1, "b", "> the very same passage"), (1, 0, "b", "> the very same passage")]
    got = [r.asDict() for r in link_quotes(frame(rows, SCHEMA)).collect() if r["role"] == "b"]
    assert {(r["turn"], r["parent_turn"]) for r in got} == {(1, 0), (0, None)}


def test_nulls_empty_long_and_repeated_rows(frame):
    long_text = "a line of a long message\n" * 3000
    rows = [(None, 0, "a", "passage of the void"), (None, 1, "a", "> passage of the void"), (3, None, "a", None), (3, 1, None, ""), (3, 2, "a", long_text)]
    df = frame(rows + rows[-2:], SCHEMA).selectExpr("*", "1 AS level", "'x' AS own_text", "2 AS hash")
    got = link_quotes(df).collect()
    assert len(got) == 7 and all(r["parent_turn"] is None and r["reply_depth"] == 0 for r in got)
    assert link_quotes(frame([], SCHEMA)).count() == 0


def plain_threads(rows, min_chars=8):
    """``(conv, turn) -> (own_text, n_quoted, n_linked, parent, thread, depth)``, message by message; turns are unique in a conversation."""
    parsed, own, result = {}, {}, {}
    for conv, turn, _, text in rows:
        lines = []
        for line in re.split("\r\n|\r|\n", text):
            marks = re.match(r"(?:[ \t]*>)+", line)
            lines.append((marks.group().count(">"), line[marks.end():]) if marks else (0, line))
        units, runs = set(), 0

        def add(kind, level, words):
            norm = re.sub(r"\s+", " ", " ".join(words).lower()).strip()
            if norm and (kind == "run" or len(norm) >= min_chars):
                units.add((level, norm))

        for kind in ("run", "paragraph", "line"):
            part = []
            for i, (level, words) in enumerate(lines):
                new = i == 0 or kind == "line" or level != lines[i - 1][0] or (kind == "paragraph" and not lines[i - 1][1].strip(" "))
                if new and part:
                    add(kind, lines[i - 1][0], part)
                runs += kind == "run" and new and level > 0
                part = [words] if new else [*part, words]
            add(kind, lines[-1][0], part)
        kept = [w for i, (level, w) in enumerate(lines) if level == 0 and not (i + 1 < len(lines) and lines[i + 1][0] > 0 and re.search(_INTRODUCTION, w))]
        parsed[conv, turn] = units, runs, re.sub(r"^\s*\n|\s+$", "", "\n".join(kept)) if runs else text
        for level, norm in units:
            if level == 0:
                own[conv, norm] = min(own.get((conv, norm), turn), turn)
    for (conv, turn), (units, runs, text) in sorted(parsed.items()):
        links = [(level, own[conv, norm]) for level, norm in units if level and own.get((conv, norm), turn) < turn]
        parent = max(links, key=lambda x: (-x[0], x[1]))[1] if links else None
        above = result[conv, parent] if links else None
        result[conv, turn] = text, runs, len(links), parent, above[4] if links else turn, above[5] + 1 if links else 0
    return result


def test_random_threads_match_a_plain_restatement(frame):
    rng = random.Random(3)
    said = ["Where does the ferry leave?", "at nine", "", "  From  the north pier ", "ok", "On Monday Ann wrote:", "a > b holds here", "yes yes yes yes"]
    rows, earlier = [], {}
    for conv in range(12):
        for turn in range(9):
            lines = [rng.choice(said) + rng.choice(["", f" {rng.randrange(4)}"]) for _ in range(rng.randrange(1, 6))]
            if turn and rng.random() < 0.8:
                old = earlier[conv, rng.randrange(turn)].split("\n")
                at = rng.randrange(len(old))
                lines[1:1] = [rng.choice([">", "> ", " >"]) + x.upper() for x in old[at : at + rng.randrange(1, 5)]]
            earlier[conv, turn] = "\n".join(lines)
            rows.append((conv, turn, "user", rng.choice(["\n", "\r\n"]).join(lines)))
    got = {(r.conv_id, r.turn): (r.own_text, r.n_quoted, r.n_linked, r.parent_turn, r.thread_turn, r.reply_depth) for r in link_quotes(frame(rows, SCHEMA)).collect()}
    assert got == plain_threads(rows) and sum(v[2] > 0 for v in got.values()) > 20


def test_many_distinct_lines_take_time_in_proportion(frame):
    own = [f"line {i} of a message of many lines" for i in range(24_000)]
    rows = [(1, 0, "a", "\n".join(own)), (1, 1, "b", "\n".join(f"> {x}\nanswer {i}" for i, x in enumerate(own[:12_000])))]
    link_quotes(frame(rows[:1], SCHEMA)).count()
    start = time.time()
    got = result(link_quotes(frame(rows, SCHEMA)))
    assert (got[1, 1]["parent_turn"], got[1, 1]["n_quoted"], got[1, 1]["n_linked"]) == (0, 12_000, 12_000)
    assert time.time() - start < 60
