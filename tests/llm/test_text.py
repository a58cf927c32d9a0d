import random
import re

import numpy as np
import pyarrow as pa

from roadweave.llm import _text as T


def test_words_and_hashes():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abAB \t\né") for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", "ab ba", "x" * 500, None]
    buf, offs = T.buffers(pa.array(texts))
    starts, ends, woffs = T.word_spans(buf, offs)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    raw = buf.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == [w for ws in words for w in ws]
    assert np.diff(woffs).tolist() == [len(w) for w in words]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for ws in words for w in ws]
    hashes = T.word_hashes(buf, starts, ends).tolist()
    # one hash for each different word: anagrams differ
    assert len(set(zip(lower, hashes))) == len(set(lower)) == len(set(hashes))


def test_shingle_sets_match_tuples():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ab", "ba", "aab", "aba"]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    buf, offs = T.buffers(pa.array(texts))
    hashes, o = T.shingle_sets(buf, offs, 5)
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        got = set(hashes[o[i] : o[i + 1]].tolist())
        assert len(got) == len(want)
        seen.setdefault(frozenset(want), set()).add(frozenset(got))
    assert all(len(v) == 1 for v in seen.values())
