"""The contract's queries: each applies one operator to a whole table and derives its digest columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import chat_rotation, decontaminate, exact_dedup, hmm_lm, license_scan, quality_rules, secret_scan, sentencepiece_codec, simhash, spelling, vector_codes, warc, weak_supervision

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codec_columns(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        more[0],
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more[1:],
    )


def codec_digest(coded: DataFrame) -> DataFrame:
    return codec_columns(coded, "doc_id")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_warcs(warc.archive_pages(_table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda p: p["label"])
    words = F.transform("places", lambda p: p["word"])
    best = F.array_max(F.transform("spans", lambda s: s["score"]))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"), F.array_max(words).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        # a phrase of the base scan counts half where the vote finds no whole template
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secret_scan(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")),
        F.sha2(secret_scan.text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.text_of(F.col("spans")).alias("spans"),
    )


def contamination_digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.withColumn("n_hit", decontaminate.hit_words("hits")).select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_rotation.rotate(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return rows.select("conv_id", "perspective", "n_turns", "n_own", "rendered", mask.alias("mask"))


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weak_supervision.quality_votes(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_warc, op3_simhash, op4_quality, op5_hmm, op6_exact_dedup, op7_license, op8_secrets, op9_decontaminate, op10_chat, op11_weak_supervision, op12_vector_codes, op13_spelling)}


def vector_codes_sql(entries: int = 16, rounds: int = 6, positions: int = 8, width: int = 8) -> str:
    """The rounds one after the other, over integers; a floor of negative quotients is made from their remainder."""
    axes = range(width)
    far = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in axes)
    steps = [
        "v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as materialized (select vec_id, pos, {', '.join(f'v[pos * {width} + {i + 1}] as x{i}' for i in axes)} from v, (select unnest(range({positions})) as pos))",
        f"c0 as materialized (select pos, row_number() over (partition by pos order by vec_id) - 1 as e, {', '.join(f'x{i} as c{i}' for i in axes)} from p where vec_id in (select vec_id from v order by vec_id limit {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, p.pos, {', '.join(f'any_value(x{i}) as x{i}' for i in axes)}, min(struct_pack(d := {far}, e := e)) as best from p join c{r} on p.pos = c{r}.pos group by vec_id, p.pos)")
        if r < rounds:
            floors = ", ".join(f"cast((sum(x{i}) - ((sum(x{i}) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as m{i}" for i in axes)
            steps.append(f"m{r} as (select pos, best.e as e, {floors} from a{r} group by pos, best.e)")
            steps.append(f"c{r + 1} as materialized (select c.pos, c.e, {', '.join(f'coalesce(m{i}, c{i}) as c{i}' for i in axes)} from c{r} c left join m{r} m on c.pos = m.pos and c.e = m.e)")
    steps.append(f"coded as (select vec_id, string_agg(printf('%02x', best.e), '' order by pos) as code, cast(sum(best.d) as bigint) as error from a{rounds} group by vec_id)")
    steps.append(f"book as (select sha256(string_agg({" || ',' || ".join(f'cast(c{i} as varchar)' for i in axes)}, ',' order by pos, e)) as sha from c{rounds})")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, sha as codebooks_sha256 from coded join v using (vec_id), book"


def weak_supervision_sql(rounds: int = 50, prior: float = 0.01) -> str:
    """Statistics, votes and the rounds of estimation, which follow each other in a recursion over the votes' numbers."""
    rules, n = weak_supervision.RULES, len(weak_supervision.RULES)
    good, bad_bad, bad_good = weak_supervision.START
    kept = lambda others: f"length(regexp_replace(t, '{others}', '', 'g'))"
    # one mark three times in a row, each of them spelt out
    runs = "|".join("".join(f"\\x{b:02X}" for _ in range(3)) for b in range(0x21, 0x7F) if not chr(b).isalnum())
    votes = ", ".join(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end" for r in rules)
    odds = f"ln(good / (1 - good)) + list_sum(list_transform(range(1, {n + 1}), lambda i: case when v[i] < 0 then ln(bg[i] / bb[i]) when v[i] > 0 then ln((1 - bg[i]) / (1 - bb[i])) else 0 end))"
    share = lambda weight, start, i: f"({prior} * total * {start} + coalesce(sum(k * {weight}) filter (v[{i}] < 0), 0)) / ({prior} * total + coalesce(sum(k * {weight}) filter (v[{i}] <> 0), 0))"
    when_good = [share("p", bad_good, i) for i in range(1, n + 1)]
    when_bad = [f"greatest({share('(1 - p)', bad_bad, i)}, {g})" for i, g in zip(range(1, n + 1), when_good)]
    return f"""
        with recursive d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
        windows as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
        twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as often from windows) where often > 1),
        repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id),
        stats as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, {kept("[^#*$%&|<>]+")} as n_symbols,
            cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
            {kept(r"\P{L}+")} as n_letters, {kept("[^A-Z]+")} as n_upper, {kept("[^0-9]+")} as n_digits, {kept("[^!?]+")} as n_bangs, {kept("[^.,;:]+")} as n_stops,
            len(regexp_extract_all(t, '{runs}')) as n_runs, len(list_filter(w, lambda x: not regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) as n_bare
            from d left join repeats r on d.doc_id = r.doc_id),
        voted as materialized (select *, [{votes}] as v from stats),
        pats as materialized (select v, count(*) as k, sum(count(*)) over () as total from voted group by v),
        em as (select 0 as round, {good}::double as good, [{bad_bad}::double for x in range({n})] as bb, [{bad_good}::double for x in range({n})] as bg
            union all select round + 1, any_value(({prior} * total * {good} + mass) / (total + {prior} * total)), any_value(b), any_value(g) from
            (select round, any_value(total) as total, sum(k * p) as mass, [{", ".join(when_bad).replace("total", "any_value(total)")}] as b, [{", ".join(when_good).replace("total", "any_value(total)")}] as g
             from (select round, v, k, total, 1 / (1 + exp(-({odds}))) as p from em, pats where round < {rounds}) group by round) group by round),
        last as (select * from em where round = (select max(round) from em)),
        scored as (select voted.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, 1 / (1 + exp(-({odds}))) as posterior from voted, last)
        select doc_id, n_words, word_chars, cast(n_symbols as bigint) as n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and posterior >= 0.5 as kept, round(posterior, 6) as posterior from scored"""


def spelling_sql(every: int = 97) -> str:
    """CRC-32 byte by byte over ``id:run`` (letters have one byte or two), words with a hole or without a letter for near ones."""
    table = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        with recursive crc as materialized (select {table}::bigint[] as tab),
        runs as materialized (select doc_id, run, count(*) as k from
            (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{upper}', '{lower}') as run from documents) group by all),
        coded as (select run, k, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
            lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])) as c from runs, crc),
        typed as (select k, case when xor(c, 4294967295::bigint) % {every} = 0
            then substr(run, 1, (xor(c, 4294967295::bigint) % length(run))::int) || substr(run, (xor(c, 4294967295::bigint) % length(run))::int + 2) else run end as word from coded),
        words as materialized (select word, cast(sum(k) as bigint) as n from typed where length(word) >= 5 group by word having sum(k) >= 3),
        holes as materialized (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as short
            from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
        near as (select a.word, b.word as other, b.n from holes a join holes b on a.hole = b.hole and a.word <> b.word
            union select l.word, w.word, w.n from holes l join words w on l.short = w.word union select w.word, l.word, l.n from holes l join words w on l.short = w.word),
        best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word),
        formed as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n
            from words w left join best b on w.word = b.word),
        chain as (select word, word as root, form as next from formed union all select c.word, f.word, f.form from chain c join formed f on c.next = f.word)
        select f.word, f.form, c.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from formed f join chain c on f.word = c.word where c.next is null"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        q as (select *, max(page_id) over (partition by html) as top from p)
        select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest,
               case when strlen(html) >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when strlen(html) >= 1000 and page_id <> top then top end as refers_to
        from q""",
    "op6_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as text from documents),
        k as (select *, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size from d)
        select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from k""",
    "op9_decontaminate": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        bw as (select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i + 12], ' ') as gram
               from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
        sizes as (select distinct size from bw),
        dw as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as gram
               from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
        hits as (select doc_id, item_id, i, dw.size from dw join bw on dw.gram = bw.gram and dw.size = bw.size),
        n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
        t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hits group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id""",
    "op10_chat": """
        with t as (select conv_id, turn, case when coalesce(role, '') = '' then 'unknown' else replace(regexp_replace(role, '[\\x00-\\x1F\\x7F\\x{85}\\x{2028}\\x{2029}]', ' ', 'g'), '<|', '< |') end as role,
                          replace(coalesce(text, ''), '<|', '< |') as text from conversations),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as ord from t),
        p as (select distinct conv_id, role as perspective from t where role <> 'system'),
        s as (select o.conv_id, perspective, ord, role = perspective as own, text || '<|im_end|>' as body,
                     '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then role else 'user name=' || role end || chr(10) as head
              from o join p on o.conv_id is not distinct from p.conv_id),
        c as (select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective order by ord
                     rows between unbounded preceding and 1 preceding), 0) + length(head) as start from s)
        select conv_id, perspective, count(*) as n_turns, count(*) filter (own) as n_own,
               string_agg(head || body || chr(10), '' order by ord) as rendered,
               coalesce(string_agg(cast(start as bigint) || ':' || cast(start + length(body) as bigint), ',' order by ord) filter (own), '') as mask
        from c group by conv_id, perspective""",
    "op11_weak_supervision": weak_supervision_sql(),
    "op12_vector_codes": vector_codes_sql(),
    "op13_spelling": spelling_sql(),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
