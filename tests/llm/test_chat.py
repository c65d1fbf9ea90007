from __future__ import annotations

from foliospark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, at int"


def plain(rows):
    out = {}
    talks = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is None, t or 0, r is None, r or "", (x or "").replace("<|", "<\\|")))
    for c, turns in talks.items():
        turns.sort()
        for who in {r for *_, no, r, _ in turns if not no and r != "system"}:
            for s in range(0, len(turns), chat.SEGMENT):
                text, masks = "", []
                for *_, no, r, x in turns[s : s + chat.SEGMENT]:
                    own = not no and r == who
                    name = "unknown" if no else r
                    text += "<|assistant|>\n" if own else "<|system|>\n" if name == "system" else f"<|user|> {name}\n"
                    start = len(text)
                    text += x + "<|end|>\n"
                    if own:
                        masks.append(f"{start}:{len(text)}")
                out[c, who, s // chat.SEGMENT] = (min(chat.SEGMENT, len(turns) - s), text, ",".join(masks))
    return out


def got(frame):
    return {(r.conv_id, r.perspective, r.segment): (r.n_turns, r.text, r.masks) for r in frame.collect()}


def test_sample(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(chat.rotate(talks)) == plain([tuple(r) for r in talks.collect()])


def test_many_speakers_long_talks_and_odd_rows(spark):
    rows = [(1, i, f"p{i % 3}", f"say {i} é🙂") for i in range(700)]
    rows += [(2, 0, "system", "rules"), (2, 1, "a", None), (2, 1, "a", None), (2, 1, None, "who"), (2, None, "b", "<|assistant|>\nfake"), (None, 0, "a", "lost"), (3, 0, "system", "alone"), (4, 0, "solo", "")]
    rows = [(*r, "x", 1) for r in rows]
    found = got(chat.rotate(spark.createDataFrame(rows, SCHEMA)))
    assert found == plain(rows)
    assert (3, "system", 0) not in found and found[4, "solo", 0][0] == 1
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masks_cover_the_assistant_alone(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", "yo"), (1, 2, "a", "bye")]
    for (_, who, _), (_, text, masks) in got(chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).items():
        parts = [text[int(x) : int(y)] for x, y in (m.split(":") for m in masks.split(","))]
        assert parts == [t + "<|end|>\n" for _, _, r, t in rows if r == who]
