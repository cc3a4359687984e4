import itertools
import re

from pyspark.sql import functions as F

from attestry.functions import lexicon as L
from attestry.operators import corpus
from attestry.sources import families, synthetic

NAMES = sorted(families.FAMILIES)
TRAIN, LATER = NAMES[:7], NAMES[7:]


def test_families_have_sentences_and_words_of_their_own(spark):
    patterns = [p for f in families.FAMILIES.values() for s in L.SECTIONS for p in f[s]]
    assert len(set(patterns)) == len(patterns)
    for own in families.FAMILIES.values():
        used = {slot for s in L.SECTIONS for p in own[s] for slot in re.findall(r"\{(\w+)\}", p)}
        assert used - {"day", "clock", "record", "initials"} == set(own["slots"]) and all(len(own[s]) >= 2 for s in L.SECTIONS)
    rows = synthetic.notes_by_family(spark, NAMES, 30).collect()
    words = {}
    for r in rows:
        assert "{" not in r.source_text and all(f.text in r.source_text and f.evidence == [f.text] for f in r.facts)
        words.setdefault(r.family, set()).update(re.findall("[a-z]{4,}", " ".join(f.text for f in r.facts).lower()))
    for a, b in itertools.combinations(NAMES, 2):
        assert len(words[a] & words[b]) <= 0.3 * min(len(words[a]), len(words[b])), (a, b)


def test_a_slot_is_one_word_in_all_of_an_event(spark):
    own = {"x": {"slots": {"thing": ["cup", "jug", "pan"]}, **{s: ["{thing} {day}"] for s in L.SECTIONS}}}
    rows = spark.range(40).select(F.lit("x").alias("family"), F.col("id").alias("n"), F.lit(1).alias("more"))
    got = families.stories(rows, families.family_table(spark, own), "s").collect()
    assert all(len({p.text for p in r.pieces}) == 1 and [p.section for p in r.pieces] == list(L.SECTIONS) for r in got)
    assert {r.pieces[0].text.split()[0] for r in got} == {"cup", "jug", "pan"}
    other = families.stories(rows.withColumn("family", F.lit("unknown")), families.family_table(spark, own), "s")
    assert other.where("pieces is null").count() == 40


def test_no_leak_from_training_to_validation_families(spark):
    rows = synthetic.curriculum(spark, TRAIN, LATER, [TRAIN[0], LATER[0]]).cache()
    assert corpus.shared_families(rows).count() == 0 and rows.select("source").distinct().count() == rows.count()
    short = rows.where(~F.col("family").isin(TRAIN[0], LATER[0]))
    side = lambda split: short.where(F.col("split") == split).select(F.col("id"), F.col("source").alias("text"))
    nearest = corpus.nearest_summary(corpus.nearest_by_trigrams(side("validation"), side("train"))).first()
    assert nearest.rows == side("validation").count() and nearest.greatest < 0.3
    # Inside a family its sentences do repeat: the audit would find a family on both sides.
    inside = short.where(F.col("family") == TRAIN[1])
    halves = [inside.where(F.col("n") % 2 == k).select(F.col("id"), F.col("source").alias("text")) for k in (0, 1)]
    assert corpus.nearest_summary(corpus.nearest_by_trigrams(*halves)).first().greatest > 0.4 > nearest.greatest
    rows.unpersist()
