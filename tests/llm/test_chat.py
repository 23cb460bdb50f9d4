from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def passages(text: str) -> list[tuple[int, str]]:
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        content = line[len(marks) :] if level else line
        if runs and runs[-1][0] == level:
            runs[-1][1].append(content)
        else:
            runs.append((level, [content]))
    return [(level, " ".join(parts)) for level, parts in runs]


def sentences(text: str) -> set[str]:
    normal = (re.sub(r"[\W_]+", " ", s.lower()).strip() for s in re.split(r"[.!?]+", text))
    return {s for s in normal if s}


def brute(messages: list[tuple[int, str]]) -> dict[int, tuple]:
    """turn -> (message_no, reply_to, branch, position) of a conversation with distinct turns."""
    ordered, said, replies = sorted(messages), {}, {}
    for seq, (_, text) in enumerate(ordered):
        targets: dict[tuple[int, int, int], int] = {}
        for number, (level, part) in enumerate(passages(text)):
            for s in sentences(part) if level else ():
                if s in said:
                    targets[number, level, said[s]] = targets.get((number, level, said[s]), 0) + 1
        if targets:
            replies[seq] = max((-level, n, first) for (_, level, first), n in targets.items())[2]
        else:
            replies[seq] = seq - 1 if seq else None
        for level, part in passages(text):
            for s in sentences(part) if not level else ():
                said.setdefault(s, seq)
    place, taken = {}, set()
    for seq in range(len(ordered)):
        to = replies[seq]
        if to is None or to in taken:
            place[seq] = (seq, 0)
        else:
            place[seq] = (place[to][0], place[to][1] + 1)
            taken.add(to)
    return {turn: (seq, replies[seq], *place[seq]) for seq, (turn, _) in enumerate(ordered)}


def thread(seed: int, n: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    own = [". ".join(" ".join(word() for _ in range(5)) for _ in range(3)) + "." for _ in range(n)]
    texts = []
    for i in range(n):
        kind, text = rng.random(), own[i]
        if i and kind < 0.6:
            first = rng.randrange(i)
            quoted = own[first].split(". ")
            text = "On Monday Ann wrote:\n> " + ".\n> ".join(quoted[: rng.randint(1, 3)]) + "\n" + text
            if kind < 0.3:
                text = ">> " + own[rng.randrange(i)] + "\n" + text
        texts.append((3 * i, text))
    return texts


@pytest.fixture(scope="module")
def threads(spark):
    convs = {c: thread(c, n) for c, n in ((1, 1), (2, 2), (3, 12), (4, 60), (5, 300))}
    rows = [(c, turn, "user", text) for c, own in convs.items() for turn, text in own]
    return convs, chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()


def test_reply_order_equals_brute_force(threads):
    convs, rows = threads
    assert len(rows) == sum(map(len, convs.values()))
    for conv_id, own in convs.items():
        got = {r.turn: (r.message_no, r.reply_to, r.branch, r.position) for r in rows if r.conv_id == conv_id}
        assert got == brute(own)


def test_each_message_follows_what_it_replies_to(threads):
    for conv_id, _ in threads[0].items():
        own = {(r.branch, r.position): r for r in threads[1] if r.conv_id == conv_id}
        for (branch, position), r in own.items():
            assert position == 0 or own[branch, position - 1].message_no == r.reply_to


def test_contents_have_no_quotes(threads):
    assert not any(line.startswith(">") or line.endswith("wrote:") for r in threads[1] for line in r.content.split("\n"))
    assert all(r.content and r.formatted == f"<|user|>\n{r.content}<|end|>\n" for r in threads[1])


def test_nested_levels_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "user", "The first message has a point. It goes on for a while, as they do."),
        (1, 1, "assistant", "An answer to it."),
        (1, 2, "user", "Something else."),
        (1, 3, "user", "On 3 May, Bob wrote:\n> > The first message has\n> > a point. It goes ON for a while as they do\n> An answer to it.\nMy view."),
    ]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].reply_to == 1 and got[3].n_links == 2 and got[3].n_quoted_lines == 3
    assert got[3].content == "My view."
    assert (got[2].branch, got[2].position) == (0, 2) and (got[3].branch, got[3].position) == (3, 0)


def test_messy_rows_and_empty_tables(spark):
    rows = [
        (None, None, None, None),
        (None, 1, "user", "> only a quote"),
        (1, 0, "user", "same"),
        (1, 0, "user", "same"),
        (1, 0, "assistant", "other"),
        (1, None, "user", ""),
        (2, 0, "user", "a <|end|> mark. " * 20_000),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("cid", "seq", "th", "part", "content", "branch")])
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    assert [(r.message_no, r.content) for r in got if r.conv_id is None and r.turn is None] == [(0, "")]
    assert [r.content for r in got if r.conv_id is None and r.turn == 1] == [""]
    same = [(r.message_no, r.position) for r in got if r.text == "same"] if "text" in got[0] else [(r.message_no, r.position) for r in got if r.content == "same"]
    assert len(same) == 2 and len(set(same)) == 1
    assert sorted({r.message_no for r in got if r.conv_id == 1}) == [0, 1, 2]
    assert "<|end|>" not in next(r for r in got if r.conv_id == 2).formatted[:-9]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
