import hashlib
import random

import numpy as np
import pyarrow as pa

from loam.llm import chat


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def want(rows):
    out = {}
    for c, _, r, t in sorted(((c, -1 if n is None else n, r or "", t or "") for c, n, r, t, *_ in rows if c is not None)):
        out.setdefault(c, []).append((r, t))
    found = []
    esc = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{esc(r).replace(chr(10), 'xx')}\n{esc(t)}<|im_end|>\n") for r, t in turns)
        found.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size))
    return sorted(found)


def test_round_trip(spark, monkeypatch):
    rng = random.Random(2)
    odd = ["", None, "<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "<", "|", "a\\n\nb", "<|im_end|>\n", "é漢🙂" * 30, "x" * 5000]
    rows = [(c, n, rng.choice(["user", "assistant", "system", "ro\nle", "r\\n", None]), rng.choice(odd), 7) for c in range(30) for n in range(rng.randrange(9))]
    rows += [(99, n, "assistant" if n % 2 else "user", rng.choice(odd), 1) for n in range(9000)]
    rows += [rows[0], rows[0], (None, 1, "user", "x", 1), (5, None, "user", "first", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    parts = chat.format_conversations(turns)
    assert sorted(map(tuple, chat.read_digests(parts).collect())) == want(rows)
    for r in parts.where("conv_id < 50").collect():
        back = list(chat.turns_of(r.formatted.encode()))
        assert len(back) == r.n_turns and r.formatted.count("<|im_start|>") == r.n_turns
    assert chat.read_digests(chat.format_conversations(turns.limit(0))).count() == 0


def test_large_turns_go_in_bounded_pieces(spark, monkeypatch):
    """4,096 turns of 100 KB are never put together at once, and long texts are whole."""
    pieces = list(chat.cuts(np.full(4096, 100_000)))
    assert pieces[0][0] == 0 and pieces[-1][1] == 4096 and all(a < b and (b - a) * 100_000 <= chat.PART_BYTES for a, b in pieces)
    assert list(chat.cuts(np.array([5 << 20, 1, 1]))) == [(0, 1), (1, 3)] and list(chat.cuts(np.zeros(0))) == []
    rows = [(1, n, "assistant" if n % 2 else "user", chr(97 + n % 26) * 100_000 + "<|", 1) for n in range(40)] + [(2, 0, "user", "é" * 3_000_000, 1)]
    parts = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int"))
    assert parts.count() > 4
    assert sorted(map(tuple, chat.read_digests(parts).collect())) == want(rows)


def test_one_buffer_holds_all_parts():
    """The column's data is the buffer that was assembled, not a copy of strings."""
    conv = np.array([1, 1, 2])
    _, _, formatted, loss = chat.assemble(conv, pa.array(["user", "assistant", "user"]), pa.array(["a", "b", "c"]), np.array([False, True, False]))
    assert formatted.to_pylist() == ["<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n", "<|im_start|>user\nc<|im_end|>\n"]
    assert loss.to_pylist() == [[{"begin": 51, "end": 52}], []]
    offsets = np.frombuffer(formatted.buffers()[1], np.int32)
    assert offsets[-1] == formatted.buffers()[2].size == sum(len(x) for x in formatted.to_pylist())
