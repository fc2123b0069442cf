import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyloom.llm import near_dedup


def variants(rng, base, changes, n, mark):
    """n texts of the words of base, each with its own words at so many random places."""
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(base)), changes()):
            words[at] = f"{mark}{i}_{at}"
        out.append(" ".join(words))
    return out


def links(texts):
    sets = [set(x.tolist()) for x in near_dedup.shingle_sets(pa.array(texts))]
    return {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}


def test_texts_of_one_template_just_below_the_similarity_make_few_pairs(spark):
    base = [f"w{i}" for i in range(300)]
    # one block of own words at the end: a share of 0.70 for each pair
    texts = [" ".join(base[:250] + [f"own{d}_{i}" for i in range(53)]) for d in range(200)]
    sets = list(near_dedup.shingle_sets(pa.array(texts)))
    assert 0.69 < len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1])) < 0.75 and not links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"))
    assert near_dedup.rare_pairs(members, docs, 75).count() <= 10 * len(texts)
    assert near_dedup.cluster(docs).where("not kept").count() == 0


def test_every_link_between_components_is_among_the_rare_pairs(spark):
    rng = random.Random(8)
    base = [[f"{g}w{i}" for i in range(n)] for g, n in (("a", 120), ("b", 60), ("c", 7))]
    texts = [t for g, b in enumerate(base) for t in variants(rng, b, lambda: rng.randint(0, min(4, len(b) // 6)), 40, f"x{g}")]
    texts += [" ".join(b[: rng.randint(5, len(b))]) for b in base for _ in range(15)]
    want = links(texts)
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3)
    component = {i: i % 50 for i in range(len(texts))}
    members = spark.createDataFrame(list(component.items()), "id long, component long")
    got = {(r.a, r.b) for r in near_dedup.rare_pairs(members, docs, 75).collect()}
    across = {(a, b) for a, b in want if component[a] != component[b]}
    assert len(across) > 100 and across <= got

    root = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in near_dedup.cluster(docs).collect()} == dict(enumerate(root))
