"""Base forms of terms, as joins: every distinct term once, whatever the corpus' length.

A term is tried as a verb, and what comes of it as a noun. Irregular forms stand in a table; others lose an ending by
the rules of detachment if what is left is a known base form. The shortest known form is taken, ties by the order of
the rules; a term without one stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of verbs and of nouns with what takes their place.
VERB_RULES = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
# Irregular verbs and nouns of business news.
IRREGULAR_VERBS = dict(
    pair.split("=")
    for pair in """am=be are=be ate=eat became=become been=be began=begin begun=begin bought=buy broke=break broken=break brought=bring built=build came=come
    chose=choose chosen=choose did=do done=do drawn=draw drew=draw driven=drive drove=drive fallen=fall fed=feed fell=fall felt=feel found=find gave=give
    given=give gone=go got=get grew=grow grown=grow had=have has=have held=hold is=be kept=keep knew=know known=know laid=lay led=lead left=leave lent=lend
    lost=lose made=make meant=mean met=meet paid=pay ran=run risen=rise rose=rise said=say sank=sink saw=see seen=see sent=send shown=show shrank=shrink
    shrunk=shrink sold=sell sought=seek spent=spend spoke=speak stood=stand struck=strike sunk=sink taken=take thought=think threw=throw thrown=throw
    told=tell took=take understood=understand was=be went=go were=be withdrawn=withdraw withdrew=withdraw won=win written=write wrote=write""".split()
)
IRREGULAR_NOUNS = dict(
    pair.split("=")
    for pair in """analyses=analysis axes=axis bases=basis children=child crises=crisis criteria=criterion feet=foot forecasters=forecaster geese=goose
    halves=half hypotheses=hypothesis indices=index knives=knife leaves=leaf lives=life matrices=matrix media=medium mice=mouse people=people phenomena=phenomenon
    series=series shelves=shelf species=species teeth=tooth theses=thesis wives=wife wolves=wolf""".split()
)


def candidates(term: Column, rules) -> Column:
    """Ranked forms of a term: itself, then what each rule makes of it; null where a rule does not apply."""
    def made(i: int, ending: str, to: str) -> Column:
        form = F.concat(F.substring(term, F.lit(1), F.char_length(term) - len(ending)), F.lit(to))
        return F.when(term.endswith(ending) & (F.char_length(term) > len(ending)), F.struct(F.lit(i).alias("rank"), form.alias("form")))

    return F.array(F.struct(F.lit(0).alias("rank"), term.alias("form")), *(made(i, *rule) for i, rule in enumerate(rules, 1)))


def _pass(terms: DataFrame, base: DataFrame, rules, irregular: dict[str, str]) -> DataFrame:
    """``(term, lemma)`` of distinct ``terms(term)``; ``base(term)`` holds the known base forms."""
    known = terms.sparkSession.createDataFrame(sorted(irregular.items()), "term string, irregular string")
    forms = terms.select("term", F.explode(candidates(F.col("term"), rules)).alias("c")).where("c is not null").select("term", "c.rank", "c.form")
    hits = forms.join(base.select(F.col("term").alias("form")).distinct(), "form", "left_semi")
    best = hits.groupBy("term").agg(F.min(F.struct(F.char_length("form").alias("size"), "rank", "form")).alias("best"))
    rows = terms.join(best, "term", "left").join(F.broadcast(known), "term", "left")
    return rows.select("term", F.coalesce("irregular", "best.form", "term").alias("lemma"))


def lemmas(terms: DataFrame, base: DataFrame) -> DataFrame:
    """``(term, lemma)`` for the distinct ``terms(term)``: first as a verb, then as a noun. Null terms are left out."""
    distinct = terms.select("term").where("term is not null").distinct()
    verbs = _pass(distinct, base, VERB_RULES, IRREGULAR_VERBS)
    nouns = _pass(verbs.select(F.col("lemma").alias("term")).distinct(), base, NOUN_RULES, IRREGULAR_NOUNS)
    return verbs.withColumnRenamed("lemma", "form").join(nouns.withColumnRenamed("term", "form"), "form").select("term", "lemma")


def lemma_counts(counts: DataFrame, table: DataFrame, doc: str) -> DataFrame:
    """``(doc, term, n)`` with terms replaced by their lemmas and added up."""
    return counts.join(table, "term").groupBy(doc, F.col("lemma").alias("term")).agg(F.sum("n").alias("n"))


def lemma_tokens(docs: DataFrame, table: DataFrame, doc: str, tokens: str) -> DataFrame:
    """``(doc, tokens)``: every array with its words replaced by their lemmas, in order; empty and null arrays stay so.

    Words are exploded with their places and come back by document, so a document id stands for one row.
    """
    placed = docs.select(doc, F.posexplode(tokens).alias("at", "term")).join(table, "term", "left")
    found = placed.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("lemma", "term").alias("w")))), lambda x: x["w"]).alias("__t"))
    return docs.select(doc, tokens).join(found, doc, "left").select(doc, F.when(F.col("__t").isNull(), F.col(tokens)).otherwise(F.col("__t")).alias(tokens))


def lemmas_sql(terms: str, base: str) -> str:
    """The same in SQL over ``terms(term)`` and ``base(term)``."""

    def one(source: str, rules, irregular: dict[str, str]) -> str:
        made = ["select term, 0 as rank, term as form from t"]
        made += [f"select term, {i}, substr(term, 1, length(term) - {len(e)}) || '{to}' from t where ends_with(term, '{e}') and length(term) > {len(e)}" for i, (e, to) in enumerate(rules, 1)]
        odd = ", ".join(f"('{a}', '{b}')" for a, b in sorted(irregular.items()))
        return f"""(with t as (select distinct term from {source} where term is not null), odd(term, irregular) as (values {odd}),
            best as (select term, arg_min(form, (length(form), rank)) as form from ({" union all ".join(made)}) where form in (select term from {base}) group by term)
            select t.term, coalesce(irregular, form, t.term) as lemma from t left join best using (term) left join odd using (term))"""

    verbs = one(terms, VERB_RULES, IRREGULAR_VERBS)
    nouns = one(f"(select lemma as term from {verbs})", NOUN_RULES, IRREGULAR_NOUNS)
    return f"(select v.term, n.lemma from {verbs} v join {nouns} n on v.lemma = n.term)"
