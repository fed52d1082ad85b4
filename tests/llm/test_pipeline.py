import re
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
from tests.conftest import SF
from tests.llm.test_jaccard import kept_by_brute_force
from tests.llm.test_packing import _tokenizer
from tests.llm.test_quality import brute as counts

from sluice.llm import mixing


def test_stages_take_effect_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        path = P.shared_dir(spark, name)
        out.write.parquet(path)
        before, docs = docs.collect(), spark.read.parquet(path)
        kept[name] = (before, docs.collect())

    before, after = kept["quality_rules"]
    assert set(after) <= set(before) and not any(counts(r.text)[5] for r in after)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in before if r.doc_id in good and not counts(r.text)[5]]
    assert len([r for r in clean if r in after]) >= 0.97 * len(clean)

    before, after = kept["exact_dedup"]
    bare = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    best = {}
    for r in before:
        k = (-len(r.text or ""), r.doc_id)
        best[bare(r)] = min(best.get(bare(r), k), k)
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())

    before, after = kept["near_dedup"]
    assert sorted(r.doc_id for r in after) == kept_by_brute_force([(r.doc_id, r.text) for r in before])[0]

    before, after = kept["mix_sources"]
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes, took, most, copies = Counter(), Counter(), Counter(), Counter(after)
    for r in before:
        sizes[r.source] += words(r)
        most[r.source] = max(most[r.source], words(r))
        assert copies[r] <= 3
    for r in after:
        took[r.source] += words(r)
    goal = mixing.targets(list(sizes.items()))
    assert set(after) <= set(before) and all(abs(took[s] - goal[s]) <= most[s] for s in goal)  # a few documents each

    before, after = kept["pack_sequences"]
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(_tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in after:
        packed[r.doc_id] += r.length
        assert len(r.ids) == 2 * r.length
    assert packed == tokens


def test_run_on_an_empty_table(spark):
    import shutil
    import tempfile

    tmp = tempfile.mkdtemp(prefix="spark-")
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp}/documents.parquet")
    shutil.copy(f"{SF}/labels.parquet", f"{tmp}/labels.parquet")
    assert P.run(spark, tmp).count() == 0
