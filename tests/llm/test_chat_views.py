"""Perspectives against a plain rendering."""

import hashlib

from joulewright.llm import chat_views as C

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "<|im_start|>assistant é😀"), (1, 3, "bob", "same turn"), (1, 4, None, "who"), (1, None, "bob", "first"),
    (2, 0, "system", "alone"), (None, 0, "ann", "no id"), (None, 1, "ann", "no id"), (3, 0, "ann", "x"), (3, 0, "ann", "x"), (4, 1, "ann", "a"), (4, 1000, "bob", "b"),
]


def plain(turns, size=None):
    clean = lambda s: (s or "").replace("<|im_", "<| im_")
    convs = {}
    for c, t, s, x in turns:
        convs.setdefault(c, []).append((t is not None, t or 0, s or "unknown", clean(x), (t or 0) // size if size else 0))
    out = {}
    for c, rows in convs.items():
        for me in {r[2] for r in rows} - {"system"}:
            for part in {r[4] for r in rows}:
                text, masks, n, own = "", [], 0, 0
                mine = sorted(r for r in rows if r[4] == part or r[2] == "system" and r[4] < part)
                for _, _, s, x, _ in mine:
                    who = "system" if s == "system" else "assistant" if s == me else f"user name={clean(s)}"
                    text += f"<|im_start|>{who}\n"
                    a = len(text)
                    text += x + "<|im_end|>"
                    if s == me:
                        masks.append(f"{a}:{len(text)}")
                        n += len(text) - a
                        own += 1
                    text += "\n"
                out[c, me, part] = (len(mine), own, text, ",".join(masks), n, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_views(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, part int")
    for size in (None, 512, 2):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in C.rotate(df, turns_per_part=size).collect()}
        assert got == plain(TURNS, size)


def test_a_long_dialogue_is_whole_and_keeps_its_system_turn(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, ("ann", "bob", "eve")[i % 3], f"line {i}") for i in range(1, 2001)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in C.rotate(df).collect()}
    assert got == plain(turns) and len(got) == 3 and all(v[0] == 2001 for v in got.values())
    cut = {tuple(r)[:3]: tuple(r)[3:] for r in C.rotate(df, turns_per_part=512).collect()}
    assert cut == plain(turns, 512) and all(v[2].startswith("<|im_start|>system\nbe kind") for v in cut.values())


def test_empty_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.rotate(df)
    assert out.count() == 0
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
