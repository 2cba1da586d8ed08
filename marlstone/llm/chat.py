"""Conversations as training texts with a loss mask, and back, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.storage import stored

#: The template's control strings: what opens and ends a user's message and one that is learned, what names any other
#: role, and what stands between the merged texts of one message. No control string holds the first character of another.
USER, USER_END, LEARNED, END, ROLE, ROLE_END, AND = "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[AND]"
#: A control string, or one that was escaped: its first character, backslashes, the rest.
CONTROL = r"([\[<])(\\*)(/?INST\]|/?ROLE\]|AND\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?ROLE\]|AND\]|/?s>)"


def escaped(text: Column) -> Column:
    """The text without control strings: each gets a backslash, one that has some gets one more; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id and the sorted array turns (turn, role, text), escaped."""
    turn = F.struct("turn", escaped(F.col("role").cast("string")).alias("role"), escaped(F.col("text")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, user: str = "user", learned: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss: the text of each conversation, and the spans (start, end; code points) that are learned.

    rows: conv_id, turn, role, text. Turns run by turn, then role and text; adjacent ones of a role are one message,
    their texts joined by a control string. A span covers the text of one turn of the learned role and no control string.
    Null turns come first, a null role has an empty name, null text is empty, a null conv_id is a conversation; repeated
    rows are repeated turns; other columns play no part; an empty table gives no rows. A conversation is one string,
    so the largest one that Spark can hold (2 GiB) bounds it and the task that makes it.
    """
    at = lambda i: F.get(F.col("turns"), i)["role"]

    def opens(role: Column) -> Column:
        return F.when(role == user, USER).when(role == learned, LEARNED).otherwise(F.concat(F.lit(ROLE), role, F.lit(ROLE_END)))

    def piece(x: Column, i: Column) -> Column:
        first, last = ~F.coalesce(at(i - 1) == x["role"], F.lit(False)), ~F.coalesce(at(i + 1) == x["role"], F.lit(False))
        head = F.when(first, opens(x["role"])).otherwise(AND)
        tail = F.when(~last, "").when(x["role"] == user, USER_END).otherwise(END)
        return F.struct(head.alias("head"), x["text"].alias("text"), tail.alias("tail"), (x["role"] == learned).alias("learned"))

    out = _turns(rows).select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    spans = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def span(a: Column, p: Column) -> Column:
        start = a["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["text"])
        own = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct((end + F.char_length(p["tail"])).cast("bigint").alias("at"), F.when(p["learned"], F.concat(a["spans"], F.array(own))).otherwise(a["spans"]).alias("spans"))

    loss = F.aggregate("pieces", F.struct(F.lit(0).cast("bigint").alias("at"), spans.alias("spans")), span, lambda a: a["spans"])
    return out.select("conv_id", whole.alias("formatted"), loss.alias("loss"))


def turns_of(text: Column, user: str = "user", learned: str = "assistant") -> Column:
    """The array (role, text) of the turns in a formatted text: each conversation as it was, null roles and texts as empty ones."""
    messages = F.filter(F.split(text, r"(?<=\[/INST\]|</s>)"), lambda m: m != "")

    def of(m: Column) -> Column:
        name = F.regexp_extract(m, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)
        theirs, ours = m.startswith(USER), m.startswith(LEARNED)
        role = F.when(theirs, user).when(ours, learned).otherwise(unescaped(name))
        head = F.when(theirs, len(USER)).when(ours, len(LEARNED)).otherwise(F.char_length(name) + len(ROLE) + len(ROLE_END))
        tail = F.when(theirs, len(USER_END)).otherwise(len(END))
        body = F.substring(m, head + 1, F.char_length(m) - head - tail)
        return F.transform(F.split(body, r"\[AND\]"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, of))


def learned_text(text: Column, loss: Column) -> Column:
    """What the spans cover, one after the other, as it was before it was escaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(rows: DataFrame) -> DataFrame:
    """What a formatted table holds, read back from it: turns with their digest, learned characters with theirs, length."""
    out = rows.select("conv_id", turns_of(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation of the contract that holds control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(stored(formatted(rows.unionByName(planted)), "formatted"))


_ESC = r"regexp_replace({0}, '([\[<])(\\*)(/?INST\]|/?ROLE\]|AND\]|/?s>)', '\1\\\2\3', 'g')"
OP11_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, (['user', 'assistant'])[i + 1], '{PLANTED}' from range(2) r(i)),
t as (select *, coalesce(lag(role) over w <> role, true) as first, coalesce(lead(role) over w <> role, true) as last from c window w as (partition by conv_id order by turn nulls first, role, text)),
n as (select *, length({_ESC.format("text")}) + case when not first then {len(AND)} when role = 'user' then {len(USER)} when role = 'assistant' then {len(LEARNED)} else {len(ROLE) + len(ROLE_END)} + length({_ESC.format("role")}) end
  + case when not last then 0 when role = 'user' then {len(USER_END)} else {len(END)} end as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from n group by conv_id"""
