import random
import re
import zlib

import numpy as np
from test_operators import SCHEMA
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm.tokens import resolve


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(words):
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return len(a & b) > 0 and 100 * len(a & b) >= 75 * len(a | b)


def documents():
    """doc_id: text, and the ids that the quality rules reject."""
    rng = random.Random(21)
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.getrandbits(30)}" for _ in range(n))
    passage, shared = line(30), line(20)
    out = {i: "\n".join(line(30) for _ in range(4)) for i in range(8)}
    out[8] = out[0]  # an exact copy
    out[9] = out[1].replace("a", "e", 1) + " " + line(3)  # a near one, line by line
    out[10] = " ".join(out[2].split()[:100]) + " " + line(8)  # a near one as a whole only
    out[11] = line(40) + " " + passage + "\n" + shared
    out[12] = line(35) + " " + passage + " " + line(20) + "\n" + shared
    out[13], out[14], out[15], out[16] = "too short", "", None, "same five words come again " * 40
    return out, {13, 14, 15, 16}


def by_brute_force():
    texts, rejected = documents()
    texts = {i: t for i, t in texts.items() if i not in rejected}
    seen, cleaned = [], {}
    for i, t in texts.items():
        stay = []
        for own_line in t.split("\n"):
            own = shingles(split(own_line))
            if not any(alike(own, o) for o in seen):
                stay.append(own_line)
            seen.append(own)
        if stay:
            cleaned[i] = "\n".join(stay)
    sets = {i: shingles(split(t.lower())) for i, t in cleaned.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if alike(sets[a], sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    one = {i: t for i, t in cleaned.items() if root[i] == i}
    starts, cut = set(), {}
    for i, t in one.items():
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in starts:
                gone[at : at + 100] = True
            starts.add(window)
        cut[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()
    return texts, cleaned, one, cut


def test_run_equals_brute_force_of_every_stage(spark, tmp_path):
    rows = [(i, t, "en", "hot" if i % 3 else "s", len(t or ""), None) for i, t in documents()[0].items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = by_brute_force()
    assert len(want[0]) > len(want[1]) > len(want[2]) and want[2] != want[3]  # every stage has something to do
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, str(tmp_path))
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    library = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    crc = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in want[3].items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == crc and all(r.piece == 0 for r in packed)
