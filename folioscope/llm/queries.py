"""The queries that apply this subpackage's operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import MinHashConfig, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), MinHashConfig(width=2))


def op2_byte_conv_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byteconv import held_out, learn, score

    docs = _table(spark, sf_dir, "documents").where("doc_id is not null")
    net = learn(docs, _table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .kmtree import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_suffix_family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import digest, remove_repeats

    return digest(remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfile import tokens_round_trip

    return tokens_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_projection_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rpforest import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_automaton_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .automaton import digest, remove_earlier

    return digest(remove_earlier(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_conflict_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import items, pack

    return pack(items(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op9_unigram_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .unigram import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).drop("target_uri")


def op13_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocation import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash_near_dedup, op2_byte_conv_quality, op3_kmeans_tree_neighbours, op4_suffix_family_dedup, op5_elias_fano_token_files, op6_projection_forest_dedup, op7_automaton_substring_dedup, op8_conflict_best_fit_packing, op9_unigram_round_trip, op10_unigram_token_counts, op11_hard_negatives, op12_warc_round_trip, op13_pivot_collocations)
    return {f.__name__: f for f in every}


#: DuckDB: the words of a text.
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The definitions in DuckDB SQL. op1 and op6 are compared with every link there is; the others of the ten have no SQL form.
ORACLES = {
    "op1_minhash_near_dedup": f"""with recursive w as (select doc_id, {_WORDS.format(_LOWER)} w from documents where doc_id is not null),
s as (select doc_id, list_sort(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) s from w),
d as (select doc_id, len(s)::bigint n, case when len(s) > 0 then min(doc_id) over (partition by md5(array_to_string(s, chr(10)))) else doc_id end rep, s from s),
x as (select rep, n, unnest(s) g from d where doc_id = rep),
p as (select a.rep a, b.rep b, any_value(a.n + b.n) n, count(*) k from x a join x b on a.g = b.g and a.rep < b.rep and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 group by 1, 2),
e as (select a u, b v from p where 100 * k >= 80 * (n - k) union all select b, a from p where 100 * k >= 80 * (n - k)),
reach(id, y) as (select u, u from e union select r.id, e.v from reach r join e on e.u = r.y),
f as (select id, min(y) c from reach group by 1)
select doc_id, n n_shingles, coalesce(c, rep) component_id, doc_id = coalesce(c, rep) kept from d left join f on f.id = d.rep""",
    "op4_suffix_family_dedup": """with b as (select doc_id, encode(coalesce(text, '')) b from documents where doc_id is not null),
n as (select doc_id, b, octet_length(b)::bigint n from b),
g as (select doc_id, unnest(range(0, n - 399)) s, unnest(list_transform(range(0, n - 399), lambda s: md5(b[s + 1 : s + 400]))) h from n),
r as (select h from g group by 1 having count(*) > 1),
m as (select doc_id, s, case when s > lag(s, 1, -1000) over (partition by doc_id order by s) + 400 then 1 else 0 end new from g semi join r using (h)),
i as (select doc_id, s, sum(new) over (partition by doc_id order by s) run from m),
u as (select doc_id, run, min(s) lo, max(s) + 400 hi from i group by 1, 2),
e as (select doc_id, lag(hi, 1, 0) over (partition by doc_id order by lo) x, lo y, hi - lo gone from u union all select doc_id, coalesce(max(hi), 0), any_value(n), null from n left join u using (doc_id) group by doc_id),
k as (select doc_id, coalesce(sum(gone), 0) n_removed, count(gone) n_spans, string_agg(hex(b[x + 1 : y]), '' order by x) kept from e join n using (doc_id) group by 1)
select doc_id, n n_bytes, n_removed::bigint n_removed, n_spans::bigint n_spans, sha256(unhex(kept)) kept_sha256 from n join k using (doc_id)""",
    "op6_projection_forest_dedup": """with recursive v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id u, b.vec_id v from v a join v b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach(id, y) as (select u, u from e union select r.id, e.v from reach r join e on e.u = r.y),
f as (select id, min(y) c from reach group by 1), k as (select u, count(*) n from e group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(c, vec_id) component_id, vec_id = coalesce(c, vec_id) kept from embeddings left join f on f.id = vec_id left join k on k.u = vec_id where vec_id is not null""",
    "op7_automaton_substring_dedup": f"""with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents where doc_id is not null),
g as (select doc_id, unnest(range(1, len(w) - 11)) i, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i : i + 12], ' ')))) h from w),
f as (select h, min(doc_id) first from g group by 1),
c as (select distinct doc_id, i + k p from (select doc_id, i from g join f using (h) where first < doc_id), range(13) t(k)),
x as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) word from w),
k as (select doc_id, count(c.p) n_removed, string_agg(x.word, ' ' order by p) filter (where c.p is null) kept from x left join c using (doc_id, p) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)""",
    "op11_hard_negatives": """with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint label, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_dot_product(a.q, b.q)::bigint score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int "rank", s.vec_id negative_id, positive_score, s.score negative_score from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 3""",
    "op12_warc_round_trip": """with p as (select page_id, encode(coalesce(html, '')) b, sha1(encode(coalesce(html, ''))) h from pages),
f as (select *, min(page_id) over (partition by h) first from p),
g as (select page_id, k, ('0x' || h[5 * k + 1 : 5 * k + 5])::bigint v from f, range(8) t(k)),
d as (select page_id, string_agg(list_aggregate(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), 'string_agg', ''), '' order by k) payload_digest from g group by 1)
select page_id, octet_length(b)::bigint payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from f join d using (page_id)""",
    "op13_pivot_collocations": f"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') w from p),
s as (select lang, w, unnest(range(1, len(w) + 1)) i from w),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase from s, range(1, 6) t(k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, count(*) f from g group by all having count(*) >= 100 or k = 1),
n as (select lang, sum(f)::bigint n from f where k = 1 group by 1),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1),
sub as (select lang, array_to_string(w[i : i + m - 1], ' ') phrase, max(a) longer from c, range(2, 5) t(m), range(1, 5) u(i) where m < k and i + m - 1 <= k group by 1, 2),
kept as (select c.* from c left join sub using (lang, phrase) where coalesce(100 * longer < 100 * a, true)),
cut as (select kept.lang, kept.phrase, a, l.f l, r.f r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint score, t.i from kept, range(1, 5) t(i), f l, f r, n
where t.i < kept.k and l.lang = kept.lang and r.lang = kept.lang and n.lang = kept.lang and l.phrase = array_to_string(kept.w[1 : t.i], ' ') and r.phrase = array_to_string(kept.w[t.i + 1 :], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, i) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score from best qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
