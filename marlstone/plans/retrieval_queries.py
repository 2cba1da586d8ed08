"""Questions answered from passages, nearest vectors, and searches by stored trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marlstone.operators import retrieval, trigram
from marlstone.plans.entity_queries import LISTED, listed
from marlstone.plans.registry import query
from marlstone.sources.tables import table

#: Words of a passage.
SIZE = 200

FOUND = rf"""
d as (select doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents where text is not null),
p as (select doc_id, i as passage, array_to_string(ws[i * {SIZE} + 1:(i + 1) * {SIZE}], ' ') as text from d, lateral unnest(range(0, (len(ws) + {SIZE - 1}) // {SIZE})) r(i)),
w as (select doc_id, passage, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from p),
st as (select count(*) as n, avg(len(t)) as mean from w),
tf as (select doc_id, passage, len(t) as size, term, count(*) as n from (select doc_id, passage, t, unnest(t) as term from w) group by all),
q as (select item_id as question, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) as term from benchmark where text is not null),
df as (select term, ln(1 + ((select n from st) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by 1),
sc as (select question, doc_id, passage, sum(cast(round(idf * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / (select mean from st)))), 8) as decimal(20, 8))) as score
  from q join df using (term) join tf using (term) group by 1, 2, 3),
found as (select question, (row_number() over (partition by question order by score desc, doc_id, passage))::int as rank, doc_id, passage, score::double as score from sc qualify rank <= 5)"""


def library(spark, d):
    return retrieval.build_index(retrieval.passages(table(spark, d, "documents"), SIZE), 16)


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text").filter("text is not null")


@query(f"with {FOUND} select question, rank, doc_id, passage, round(score, 4) as score from found")
def retrieved_passages(spark, d):
    """Each item of the benchmark as a question on all documents."""
    return retrieval.search(library(spark, d), questions(spark, d), 5).withColumn("score", F.round("score", 4))


@query(rf"""with {FOUND}, c as (select question, rank, doc_id, passage, array_to_string(string_split(text, ' ')[1:8], ' ') as said from found join p using (doc_id, passage) where rank <= 2),
e as (select * from c where len(regexp_extract_all(said, '[\p{{L}}\p{{N}}]+')) > 0)
select question, (select string_agg(rank || ':' || doc_id || ':' || passage, ',' order by rank) from e where e.question = b.item_id) as citations from (select item_id, item_id as question from benchmark where text is not null) b""")
def cited_answers(spark, d):
    """Answers of the stand-in model, whose last claims no source holds, with the passages that they cite rightly."""
    rows = retrieval.answers(library(spark, d), questions(spark, d), 5)
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["number"], c["doc_id"], c["passage"])), ",")
    return rows.select("question", F.when(F.size("citations") > 0, cited).alias("citations"))


@query("""with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as vector from embeddings where embedding is not null),
s as (select q.id as question, v.id, round(list_dot_product(q.vector, v.vector) / sqrt(list_dot_product(v.vector, v.vector)) / sqrt(list_dot_product(q.vector, q.vector)), 8) as score from v q join v on q.id % 100 = 0)
select question, (row_number() over (partition by question order by score desc, id))::int as rank, id, round(score, 6) as score from s qualify rank <= 10""")
def nearest_vectors(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.nearest(rows, rows.filter("id % 100 = 0").withColumnRenamed("id", "question"), 10)
    return found.withColumn("score", F.round("score", 6))


def texts(spark, d):
    """What is searched for: a symbol, part of a name, a start of a name, a whole contract in other case, a start of one, and one that is not 0x."""
    first = lambda start: listed(spark, d).filter(F.col("contract").startswith(start)).agg(F.min_by("contract", "asset_id")).first()[0]
    address, other = first("0x"), first("So")
    return ["Brand#12", "d Widget", "small", *([address.lower(), address[:9]] if address else []), *([other] if other else [])]


@query(f"""with {LISTED}, x as (select min_by(contract, asset_id) filter (contract like '0x%') as a, min_by(contract, asset_id) filter (contract like 'So%') as o from listed),
q as (select unnest(['Brand#12', 'd Widget', 'small', lower(a), a[1:9], o]) as q from x),
r as (select q, asset_id, case when (case when contract like '0x%' then lower(contract) else contract end) = (case when q like '0x%' then lower(q) else q end) then 0 when lower(symbol) = lower(q) then 1
  when starts_with(lower(symbol), lower(q)) or starts_with(lower(name), lower(q)) or (q like '0x%' and starts_with(case when contract like '0x%' then lower(contract) else contract end, lower(q))) then 2
  when contains(lower(symbol), lower(q)) or contains(lower(name), lower(q)) then 3 end as rank from listed, q where q is not null)
select q, asset_id, rank from r where rank is not null""")
def search_indexed(spark, d):
    """Searches by the stored postings, rank 0 (contract) to 3."""
    index = trigram.build_index(listed(spark, d), 16)
    rows = [trigram.search(index, q).select(F.lit(q).alias("q"), "asset_id", "rank") for q in texts(spark, d)]
    return reduce(lambda a, b: a.unionByName(b), rows)


_TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query(f"""with {LISTED}, x as (select asset_id, 'name' as field, name as t from listed union all select asset_id, 'symbol', symbol from listed),
s as (select asset_id, field, len(list_intersect({_TRI.format("t")}, {_TRI.format("'smal widgets'")})) / len(list_distinct(list_concat({_TRI.format("t")}, {_TRI.format("'smal widgets'")}))) as similarity from x where t is not null)
select asset_id, field, round(similarity, 8) as similarity from s where similarity >= 0.3""")
def similar_names(spark, d):
    """Names like one that is misspelt, by the postings of its trigrams alone."""
    return trigram.similar(trigram.build_index(listed(spark, d), 16), "smal widgets").withColumn("similarity", F.round("similarity", 8))
