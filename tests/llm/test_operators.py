import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import chat, line_dedup, near_dedup, packing, pfor, quality_rules, queries, suffix_dedup, topk, url_filter
from keyloom.llm.tokens import encoder, resolve

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r_spans string"
VOCABULARY = ["the", "of", "tion", "ab", "é", "日本", "x1", "#", "***", "\n", "a\nb", "<", "  "]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + (str(rng.randint(0, 30)) if rng.random() < 0.7 else "") for _ in range(n))


def texts():
    """Nulls, empty and long texts, exact and near copies, and shared passages."""
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(4)]
    out = [None, "", " \n", "one", "a b c d", "a" * 300, "same line here\n" * 5]
    for i in range(40):
        words = base[i % 4].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = f"new{i}"
        out.append(" ".join(words) if i % 5 else prose(rng, 30) + "\n" + base[i % 4][:400] + "\n" + prose(rng, 20))
    return [*out, prose(rng, 20000), base[0], base[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "hot" if i % 3 == 0 else "s", len(t or ""), None) for i, t in enumerate(texts())], SCHEMA).repartition(3).cache()


def test_encoder_equals_the_library():
    one, library = encoder(resolve("byte_bpe_50k.json")), Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(2)
    parts = ["a", " ", "\n", "\t", "é", "'ll", "12", "#", "\xa0", "\u2028", "😀", "日", "The", "<|endoftext|>", "\0"]
    for x in [*(t for t in texts() if t), *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500))]:
        assert np.frombuffer(one.encode(x), np.uint32).tolist() == library.encode(x, add_special_tokens=False).ids, repr(x[:80])


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in rng.normal(size=6).round(1)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, []), (350, [0.0] * 6), (350, [0.0] * 6)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), 5, vector_block=90, query_block=3).collect())
    vectors = {i: np.floor(256 * np.array(v)).astype(int) for i, v in x if v and None not in v and np.isfinite(v).all()}
    want = [(q, r + 1, j, int(-s)) for q in vectors if q % 50 == 0 for r, (s, j) in enumerate(sorted((-int(vectors[q] @ v), j) for j, v in vectors.items() if j != q)[:5])]
    assert got == sorted(want)
    assert topk.search(df.where("1 = 0"), df, 5).count() == 0


def test_suffix_dedup_equals_brute_force(docs):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                cover[at : at + 100] = b"\1" * 100
            seen.add(window)
        runs = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        want[i] = (len(raw), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).hexdigest())
    assert got == want


def test_rows_with_one_id_keep_their_text_once(spark):
    rng = random.Random(8)
    one, two, three, four = (" ".join(f"{rng.choice('abcdefgh')}{rng.getrandbits(40)}" for _ in range(60)) for _ in range(4))
    rows = [(1, one, "en", "a", len(one), None), (1, one, "en", "b", len(one), None), (2, two, "en", "s", len(two), None), (2, three, "en", "s", len(three), None), (3, four, "en", "s", len(four), None), (4, one, "en", "s", len(one), None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = sorted([one, two, three, four])
    got = suffix_dedup.digest(df).collect()
    assert len(got) == 6 and sorted(r.kept_sha256 for r in got if r.n_removed == 0) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in whole)
    assert sorted((r.doc_id, r.n_removed) for r in got if r.n_removed) == [(1, len(one)), (4, len(one))]
    assert sorted(r.text for r in suffix_dedup.clean_documents(df).collect() if r.text) == whole
    kept = near_dedup.keep_one(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (2, two), (2, three), (3, four)])


def test_repeated_rows_pass_the_pipeline_once(spark):
    rng = random.Random(9)
    x = [" ".join(f"{rng.choice('abcdefgh')}{rng.getrandbits(40)}" for _ in range(80)) for _ in range(3)]
    out = spark.createDataFrame([(i, t, "en", "s", len(t), None) for i, t in ((1, x[0]), (1, x[0]), (2, x[1]), (3, x[2]), (3, x[2]))], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert {r.text for r in out.collect()} == set(x), name
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i + 1, t) for i, t in enumerate(x)]
    library = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    ids = [library.encode(t, add_special_tokens=False).ids + [0] for t in x]
    packed = corpus_pipeline.STAGES[-1][1](spark, out, "").collect()
    assert sum(r.length for r in packed) == sum(map(len, ids)) and {r.doc_id for r in packed} == {1, 2, 3}


def test_cleaned_documents_keep_their_columns(docs):
    for clean in (suffix_dedup.clean_documents, line_dedup.clean_documents, quality_rules.filter_documents, near_dedup.keep_one):
        assert clean(docs).columns == docs.columns
    assert suffix_dedup.clean_documents(docs.where("1 = 0")).count() == 0


def test_levels_find_every_repeat():
    rng = np.random.default_rng(0)
    family, entries = suffix_dedup.SuffixLevels(), []
    repeats = 0
    for b in range(40):
        batch = np.zeros(25, suffix_dedup.ENTRY)
        batch["print"] = rng.integers(0, 300, 25)
        batch["doc"], batch["at"] = rng.permutation(25) + 100 * (40 - b), 0
        entries += [(int(p), int(d)) for p, d in zip(batch["print"], batch["doc"])]
        repeats += sum(len(x) for x in family.add(batch))
    kept = {int(e["print"]): int(e["doc"]) for level in family.rest() for e in level}
    first = {}
    for p, d in entries:
        first[p] = min(d, first.get(p, d))
    assert kept == first and repeats == len(entries) - len(first)
    assert len(family.levels) <= 8


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_dedup_equals_brute_force(docs):
    sets = {i: shingles(t) for i, t in enumerate(texts())}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.cluster(docs).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}
    assert near_dedup.cluster(docs.where("1 = 0")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(103, 130), (90, 130)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in [90, 130, *range(100, 120)]} == {90}


def test_quality_measures_equal_brute_force(docs):
    got = {r.doc_id: r for r in quality_rules.assess(docs).collect()}
    for i, t in enumerate(texts()):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
        seen = collections.Counter(x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        want = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), sum(seen.values()) - len(seen), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert tuple(got[i])[1:7] == want, i
        assert not (got[i].base_failed and got[i].kept)


def test_quality_shares_reject_what_the_base_rule_keeps(spark):
    words = [f"w{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(12)]
    repeated = " ".join(passage + words[:100] + passage + words[100:150] + passage + words[150:] + passage)
    line = "averyverylongword anotherverylongword"
    lines = "\n".join(f"{line}\n{' '.join(f'line{6 * i + j}' for j in range(6))} {'x' * 40}{i}" for i in range(15))
    rows = [(1, " ".join(words)), (2, repeated), (3, lines), (4, " ".join(words[:60] + words[:5]))]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert max(got[3].dup_ngram_chars) == 0 and 0.2 < got[3].dup_line_chars / got[3].word_chars < 0.3
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}


def test_blocks_round_trip_and_single_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 4000):
        ids = np.where(rng.random(n) < 0.1, rng.integers(0, 1 << 32, n), rng.integers(0, 500, n)).astype(np.uint32)
        starts, raw = pfor.encode_blocks(ids)
        assert (pfor.decode_blocks(starts, raw, n) == ids).all()
        segment = pfor.encode_segment([3, 4], [ids[: n // 2].tobytes(), ids[n // 2 :].tobytes()])
        assert (pfor.decode_segment(segment)[2] == ids).all()
        if n > 128:
            assert (pfor.read_block(segment, 1) == ids[128:256]).all()


def test_tokens_read_back_equal_the_library(docs):
    library = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in pfor.round_trip(docs).collect()) == want


def test_packing_is_whole_and_tight(docs):
    library = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts())}
    per, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32).tobytes())
        per[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, own in per.items():
        assert sum(x[2] for x in own) == len(ids[i]) and [x[0] for x in sorted(own)] == list(range(len(own)))
        assert all(x[2] == 2048 for x in sorted(own)[1:])
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(per) == set(ids) and len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_local_search_keeps_every_piece():
    rng = random.Random(4)
    for low, high in ((1, 100), (30, 60), (34, 51)):
        histogram = {rng.randint(low, high): rng.randint(1, 40) for _ in range(60)}
        before = packing.best_fit(histogram, 100)
        after = packing.local_search(before, 100)
        count = collections.Counter()
        for pattern, n in after.items():
            assert sum(pattern) <= 100
            for x in pattern:
                count[x] += n
        assert count == collections.Counter(histogram) and sum(after.values()) <= sum(before.values())
    assert packing.best_fit({}, 100) == {}


def test_local_search_empties_bins_where_best_fit_is_not_at_the_bound():
    rng = random.Random(1)
    for low, high, least_gone in ((30, 60, 50), (25, 45, 5)):
        histogram = collections.Counter(rng.randint(low, high) for _ in range(20000))
        before = packing.best_fit(histogram, 100)
        after = packing.local_search(before, 100)
        squares = lambda bins: sum(n * sum(p) ** 2 for p, n in bins.items())
        assert sum(before.values()) - sum(after.values()) >= least_gone and squares(after) > squares(before)
        assert sum((collections.Counter({x: p.count(x) * n for x in set(p)}) for p, n in after.items()), collections.Counter()) == histogram


def test_chat_reads_back(spark):
    said = "</s>[INST] ok [/INST] <|end|>\n<|turn|>&lt; 日"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "system", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, None, None, "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    for c in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == c]
        plain = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(plain.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest(df.where("1 = 0")).count() == 0


def test_branches_are_ranked_by_score(spark):
    nodes = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 2.0), (1, 4, 3, "user", "more", 0.5)], "tree long, node long, parent long, role string, text string, score double")
    got = chat.format_paths(nodes, best=1).collect()
    assert [(r.leaf, r.path_rank, r.path_score) for r in got] == [(4, 1, 2.5)] and "high" in got[0].formatted and "low" not in got[0].formatted


def test_line_dedup_equals_brute_force(docs):
    lines, want = [], {}
    for i, t in enumerate(texts()):
        stay, n, gone = [], 0, 0
        for x in (t or "").split("\n"):
            words = re.findall(r"[^\x20\x09-\x0D]+", x)
            if not words:
                stay.append(x)
                continue
            own = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
            n += 1
            if any(100 * len(own & o) >= 75 * len(own | o) for o in lines):
                gone += 1
            else:
                stay.append(x)
            lines.append(own)
        want[i] = (n, gone, hashlib.sha256("\n".join(stay).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup.digest(docs).collect()} == want


def test_url_rules_and_held_out_accuracy(spark):
    rng = random.Random(1)
    good = [f"https://a{rng.randint(0, 99)}.example.net/de/{rng.randint(0, 7)}{rng.randint(0, 999)}" for _ in range(400)]
    spam = [f"http://win{rng.randint(0, 99)}.example.org/es/{rng.randint(0, 999)}" for _ in range(400)]
    odd = [None, "", "no scheme", "ftp://EXAMPLE.com/en/7?x", "http://notcom/en/", "http://b.example.net/de/8", "x://h"]
    unseen = [u.replace("/de/", "/en/") for u in good[:50]] + [u.replace("/es/", "/en/") for u in spam[:50]]
    df = spark.createDataFrame(list(enumerate(good + spam + odd + unseen)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df, queries.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(800, 807)][3] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[800].host == got[802].path == "" and got[804].rule is None and got[805].rule == "example.net/de/8" and got[806].host == "h"
    right = sum(got[807 + i].verdict == ("allow" if i < 50 else "block") for i in range(100))
    assert right >= 90
    assert url_filter.judge(df.where("1 = 0"), queries.RULES).count() == 0


def test_url_counts_are_exact_and_grow(spark):
    rng = random.Random(6)
    urls = [(i, f"https://{'example.net/de/1' if i % 2 else 'example.org/es/'}{rng.getrandbits(160):040x}") for i in range(2400)] + [(2400, "http://none.info/x"), (2401, None), (2402, "http://none.info/x")]
    got = {r.page_id: r.score for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), queries.RULES).collect()}
    held = {r.url for r in spark.createDataFrame(urls, "page_id long, url string").where("pmod(xxhash64(url), 10) = 0").collect()}

    def grams(url):
        x = [256] * 4 + list(url.encode())
        return [tuple(x[i - 4 : i + 1]) for i in range(4, len(x))]

    known = [(u, i % 2) for i, u in urls[:2400] if u not in held]
    seen = [collections.Counter(), collections.Counter()]
    for u, kind in known:
        for g in grams(u):
            seen[kind].update([g[4 - order :] for order in range(5)] + [("before", *g[4 - order : 4]) for order in range(5)])
    distinct = {g for kind in seen for g in kind if len(g) == 5 and g[0] != "before"}
    follow = [collections.Counter(g[:-1] for g in kind if g[0] != "before") for kind in seen]
    assert len(distinct) > 1 << 15
    assert url_filter.learn(spark.createDataFrame([(u, k == 1) for u, k in known], "url string, allow boolean")).count() == len(distinct)
    for i, u in [*urls[:20], *urls[2400:]]:
        total = 0.0
        for g in grams(u or ""):
            for kind, sign in ((1, 1), (0, -1)):
                p = 1 / 256
                for order in range(5):
                    before = g[4 - order : 4]
                    kinds, n = follow[kind][before], seen[kind][("before", *before)]
                    p = (seen[kind][g[4 - order :]] + kinds * p) / (n + kinds) if n else p
                total += sign * np.log(p)
        assert abs(got[i] - total / max(1, len((u or "").encode()))) < 1e-9, u
