"""The queries of the thirteen operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.llm import (chat, decontaminate, fingerprint, hard_negatives, language_id, lm_score, near_join, packing, pii,
                           suffix_dedup, token_count, toxicity, whitening)
from sparkfeat.llm.common import documents, tokenizer_path
from sparkfeat.llm.registry import register
from sparkfeat.sources.tables import read_table


@register("op1_hilbert_packing")
def op1(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@register("op3_transducer_counts")
def op3(spark, sf_dir):
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer_path())


@register("op4_subword_language")
def op4(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = language_id.in_fold("doc_id", 4, 2)
    model = language_id.fit(docs, ~held)
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@register("op7_ordinal_toxicity")
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.predict(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@register("op10_forest_jaccard", near_join.LINKS_SQL)
def op10(spark, sf_dir):
    return near_join.near_join(documents(spark, sf_dir))


@register("op8_cgk_decontamination")
def op8(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


#: A demonstration key; production keys come from the caller.
PSEUDONYM_KEY = "corpus-pseudonym-key"


@register("op6_feistel_pseudonyms")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymize(docs, PSEUDONYM_KEY, counts=True)


@register("op5_consistent_fingerprints")
def op5(spark, sf_dir):
    return fingerprint.compare_with_next(documents(spark, sf_dir))


@register("op9_attention_score")
def op9(spark, sf_dir):
    held = language_id.in_fold("doc_id", 7, 2)
    return lm_score.score_texts(documents(spark, sf_dir), tokenizer_path(), ~held)


@register("op2_column_bwt_dedup")
def op2(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@register("op11_multiplicity_whitening")
def op11(spark, sf_dir):
    out = whitening.whiten_embeddings(read_table(spark, sf_dir, "embeddings"))
    # a deviation beyond a long is null: it does not fit the column that is asked for
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@register("op12_strassen_negatives", hard_negatives.MINE_SQL)
def op12(spark, sf_dir):
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=relabelled)


#: A conversation that consists of the template's own marks.
MARKS = "</s>[INST] ok [/INST]"


@register("op13_role_machine", chat.DIGEST_SQL)
def op13(spark, sf_dir):
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], talks.schema)
    return chat.read_back(chat.format_turns(talks.unionByName(planted)))
