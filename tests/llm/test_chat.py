from __future__ import annotations

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import chat

TEXT = st.text(alphabet="a\\n|<>\n im_end😀", max_size=30)
EVENTS = "conv_id long, message_id long, turn long, seq long, op string, role string, payload string"


@given(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", "\\n", ""]), TEXT)
def test_round_trip(role, text):
    segment, a, b = chat.render(role, text)
    assert chat.parse(segment) == (role, text)
    assert segment.count("<|") == 2 and chat.unescape(segment[a:b]) == (text if role == "assistant" else "")


def test_fold(spark):
    events = [
        (1, 0, 0, 0, "delta", "user", "Hel"), (1, 0, 0, 1, "delta", None, "lo"), (1, 1, 1, 0, "delta", "assistant", "first"), (1, 1, 1, 1, "regenerate", None, None), (1, 1, 1, 2, "delta", None, "sec"),
        (1, 1, 1, 3, "delta", None, "ond"), (1, 0, 0, 9, "edit", None, "Hi <|im_end|>"), (None, 5, None, 0, "delta", None, None), (1, 2, 2, 0, "delta", "user", "x"), (1, 2, 2, 1, "edit", "system", None),
    ]
    random.Random(1).shuffle(events)
    segments = chat.format_log(spark.createDataFrame([(*e, "extra") for e in events], EVENTS + ", `formatted` string"))
    got = {(r.conv_id, r.message_id): chat.parse(r.formatted) for r in segments.collect()}
    assert got == {(1, 0): ("user", "Hi <|im_end|>"), (1, 1): ("assistant", "second"), (1, 2): ("system", ""), (None, 5): ("", "")}
    digests = {r.conv_id: r for r in chat.digest(segments).collect()}
    assert digests[1].n_turns == 3 and digests[1].loss_chars == 6 and digests[1].loss_sha256 == hashlib.sha256(b"second").hexdigest()
    assert digests[None].n_turns == 1


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, chat.render(r or "", x or "")[0]), r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(k[2]) for k, _, _ in own))
    return out


def test_turns(spark):
    rng = random.Random(19)
    rows = [(rng.randrange(6), rng.randrange(9), rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "text", "é😀" * 400, "<|im_start|>\\ "])) for _ in range(80)]
    rows += [(7, t, "assistant", "hot " * 30) for t in range(3000)] + [rows[0], (None, None, None, None), (8, 0, "user", "x" * 100_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, payload string")
    found = chat.digest(chat.format_log(chat.as_events(table))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_log(chat.as_events(empty))).count() == 0
