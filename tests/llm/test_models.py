"""The quality model against a plain EM, and shards against plain ranking and cutting."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tallywind.llm import quality, sharding
from tallywind.llm.tables import land, table

FOLDER = "/root/testdata/sf0.001"


def em(votes, rules, rounds=40):
    """Posteriors of rows of -1, 0, 1 (against, abstains, for), estimated row by row."""
    prior, good, bad = 0.8, [0.9] * rules, [0.7] * rules

    def posterior(row):
        logit = math.log(prior / (1 - prior))
        for j, v in enumerate(row):
            if v == 1:
                logit += math.log(good[j] / (1 - bad[j]))
            elif v == -1:
                logit += math.log((1 - good[j]) / bad[j])
        return 1 / (1 + math.exp(-logit))

    for _ in range(rounds):
        post = [posterior(row) for row in votes]
        prior = (sum(post) + 0.8) / (len(votes) + 1)
        voted = [[(row[j], p) for row, p in zip(votes, post) if row[j]] for j in range(rules)]
        good = [(sum(p for v, p in x if v == 1) + 0.9) / (sum(p for _, p in x) + 1) for x in voted]
        bad = [(sum(1 - p for v, p in x if v == -1) + 0.7) / (sum(1 - p for _, p in x) + 1) for x in voted]
    return posterior


def test_quality_verdicts_match_a_plain_em(spark):
    features = quality.vote(quality.add_features(table(spark, FOLDER, "documents")))
    voted = land(features.select(F.col("doc.doc_id"), *[c for c in features.columns if c != "doc"]))
    rows = quality.judge(voted).withColumn("failed", quality.base_failed()).collect()
    m = len(quality.RULES)
    votes = {r.doc_id: [r.votes // 3**j % 3 - 1 for j in range(m)] for r in rows}
    for r in voted.limit(40).collect():
        for j, rule in enumerate(quality.RULES):
            side = voted.where(F.col("doc_id") == r.doc_id).select(F.expr(f"CASE WHEN {rule.good} THEN 1 WHEN {rule.bad} THEN -1 ELSE 0 END")).first()[0] if r.doc_id < 2 else votes[r.doc_id][j]
            assert votes[r.doc_id][j] == side
    posterior = em([votes[r.doc_id] for r in rows if not r.failed], m)
    for r in rows:
        want = posterior(votes[r.doc_id])
        assert abs(r.posterior - want) < 1e-6
        if abs(want - 0.5) > 1e-6:
            assert r.good == (want >= 0.5)


def test_shards_match_plain_ranks_and_cuts(spark):
    r = random.Random(2)
    rows = [(i, f"text {i} " * r.randrange(0, 4), r.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    number = {x[0]: x[1] for x in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text")).collect()}
    groups = {}
    for i, _, source in rows:
        groups.setdefault("" if source is None else "=" + source, []).append(i)
    mixed = []
    for name, ids in groups.items():
        ids.sort(key=number.get)
        mixed += [((2 * k + 1) / (2 * len(ids)), name, number[i], i) for k, i in enumerate(ids)]
    for shards in (24, 7):
        want, taken = {}, {}
        for place, (_, _, _, i) in enumerate(sorted(mixed)):
            shard = place * shards // len(rows)
            want[i] = (shard, taken.get(shard, 0))
            taken[shard] = taken.get(shard, 0) + 1
        got = {x.doc_id: (x.shard, x.slot) for x in sharding.assign_shards(docs.repartition(3), shards).collect()}
        assert got == want
