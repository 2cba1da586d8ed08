"""Katz backoff language model with Good-Turing discounts, of any order.

Documents are dealt into groups of about GROUP_BYTES of text. A group sends each of its distinct n-grams of each
order once, packed in sorted binary ranges of the hash value, to the task that holds that range; the task adds the
groups' counts up and answers each group in the order of its own n-grams. The answers are the stored model: tables of
counts and of the sums behind the backoff weights, partitioned by order. Scoring reads them, and evaluates
the backoff recursively from order to order. From order 3 on a group sends only n-grams whose two parts other groups
have, too; others can't have the rest. What is shuffled is the distinct n-grams of groups, never tokens. A
context that only one group has gets its weight there and isn't sent. With the last sums that it asks for, a group sends
its documents' scores but for these, and where they enter; they pass through, so the scores need no further pass over the texts.

With more ranges than FANOUT, relays stand between: a relay adds the packets of a bunch of groups up for a bunch of
ranges, so no task sends to or hears from more than about FANOUT others, and a frequent n-gram reaches its range once
from each bunch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import U64, cuts, distinct_places, mix, pack_sorted, planes, tokens, unpack_sorted, unplanes
from marlstone.storage import drop_path, new_path, release_shuffles, stored

ORDER = 3
GROUP_BYTES, RANGE_BYTES, FANOUT = 4_000_000, 8_000_000, 3_000
#: Counts above TOP are not discounted.
TOP = 5
END, BEGIN = mix(np.array([11, 12], U64))
STEP = U64(0xD6E8FEB86659FD93)
#: g: whose the packet is, p: its range; kind: COUNT, SUM, WANT (of sums) or STATS, and the order, or OPEN or DOCS; a to c: keys and values.
PACKET = "p long, g long, kind int, a binary, b binary, c binary, stats array<long>"
NAMES = [x.split()[0] for x in PACKET.split(", ")]
PACKET_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
COUNT, SUM, WANT, STATS = 10, 20, 30, 40
#: Scores without the highest order's wanted sums: where these enter, and the documents with what the rest makes.
OPEN, DOCS = 50, 51
#: Flags of a count: the group stands for the n-gram; others have it, too; others have it in texts that are held out.
OWN, SHARED, HELD = 1, 2, 4
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packets(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    return pa.table([pa.array(x, k) for x, k in zip(columns, PACKET_TYPES, strict=True)], names=NAMES)


class Group:
    """The n-grams of a group of documents: each document begins with BEGIN, which is no token, and ends with END.

    For each order m: keys[m], sorted and distinct; place[m], which of them ends at each position (only where seen_from[m]
    holds: the document has m tokens there); context[m] and suffix[m], the places of each n-gram without its last and
    without its first token among those of order m - 1.
    """

    def __init__(self, table: pa.Table, order: int):
        texts = [x.encode() for x in table["text"].to_pylist()]
        self.order, self.held = order, np.array(table["held_out"].to_pylist(), bool)
        words, bounds = tokens(texts)
        self.n_tokens = np.diff(bounds) + 1
        length = self.n_tokens + 1
        self.doc = np.repeat(np.arange(len(texts), dtype=np.uint32), length)
        last = np.cumsum(length) - 1
        first = last - length + 1
        seq = np.empty(len(words) + 2 * len(texts), U64)
        inner = np.ones(len(seq), bool)
        inner[first] = inner[last] = False
        seq[inner], seq[first], seq[last] = words, BEGIN, END
        self.inside = np.arange(len(seq)) - first[self.doc]
        del words, inner
        self.keys, self.place, self.context, self.suffix = {}, {}, {}, {}
        h = seq
        for m in range(1, order + 1):
            if m > 1:
                h = np.concatenate([np.zeros(1, U64), mix(h[:-1] * STEP + seq[1:])])
            at = np.flatnonzero(self.inside >= m - 1)
            keys, place = distinct_places(h[at])
            self.keys[m], self.place[m] = keys, np.zeros(len(seq), np.uint32)
            self.place[m][at] = place
            if m > 1:
                some = np.empty(len(keys), np.int64)
                some[place] = at
                self.context[m], self.suffix[m] = self.place[m - 1][some - 1], self.place[m - 1][some]

    def n(self, m: int, held: bool = False) -> np.ndarray:
        """How often each n-gram of order m stands in training documents, or in those that are held out."""
        counted = (self.held == held)[self.doc] & (self.inside >= m - 1)
        return np.bincount(self.place[m][counted], minlength=len(self.keys[m]))

    def used(self, m: int) -> np.ndarray:
        """Which n-grams of order m stand before another token."""
        out = np.zeros(len(self.keys[m]), bool)
        out[self.context[m + 1]] = True
        return out


def answers(table: pa.Table, kind: int, column: str, dtype, lines: int = 1) -> np.ndarray:
    """The answers of all ranges to what a group sent, in its order; lines: arrays that each answer holds."""
    at = np.flatnonzero(table["kind"].to_numpy() == kind)
    rows = sorted((table["p"][i].as_py(), i) for i in at.tolist())
    found = [unplanes(table[column][i].as_py(), dtype).reshape(lines, -1) for _, i in rows]
    out = np.concatenate(found, axis=1) if rows else np.empty((lines, 0), dtype)
    return out if lines > 1 else out[0]


def ask(g: int, kind: int, keys: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple]:
    """Packets of sorted keys and of what belongs to each, for the ranges that they fall in."""
    at, rows = cuts(keys, parts), []
    for p in np.flatnonzero(at[1:] > at[:-1]).tolist():
        lo, hi = at[p], at[p + 1]
        more = [planes(np.ascontiguousarray(x[..., lo:hi]).ravel()) for x in columns]
        rows.append((p, g, kind, pack_sorted(keys[lo:hi]), *more, *[None] * (2 - len(more)), None))
    return rows


def merged(rows: list[dict]):
    """(distinct keys of packets of one kind, place of every key among them, where each packet's begin)."""
    keys = [unpack_sorted(r["a"]) for r in rows]
    distinct, place = distinct_places(np.concatenate(keys))
    return distinct, place, np.concatenate([[0], np.cumsum([len(k) for k in keys])])


def counted(rows: list[dict], place: np.ndarray, n: int):
    """Of packets of counts: each distinct key's total and first sender with a count, and each sent key's flags but OWN."""
    own = np.concatenate([unplanes(r["b"], np.int64) for r in rows])
    held = np.concatenate([unplanes(r["c"], np.uint8) for r in rows])
    seen = np.flatnonzero(own > 0)
    first = np.full(n, -1, np.int64)
    first[place[seen[::-1]]] = seen[::-1]
    flags = np.where(np.bincount(place)[place] > 1, np.uint8(SHARED), np.uint8(0))
    flags[np.bincount(place, held, n)[place] > held] |= HELD
    return np.bincount(place, own, n).astype(np.int64), first, flags


def summed(rows: list[dict], place: np.ndarray, n: int):
    """Of packets of sums, each distinct key's."""
    sizes = [len(unplanes(r["c"], np.float64)) for r in rows]
    number = np.concatenate([unplanes(r["b"], np.int64).reshape(TOP + 1, k) for r, k in zip(rows, sizes, strict=True)], axis=1)
    number = np.array([np.bincount(place, x, n) for x in number]).astype(np.int64)
    return number, np.bincount(place, np.concatenate([unplanes(r["c"], np.float64) for r in rows]), n)


def sums_of(order: int, keys: np.ndarray, found: dict[int, list[dict]]):
    """The sums of keys, where packets have some, else zeros."""
    number, den = np.zeros((TOP + 1, len(keys)), np.int64), np.zeros(len(keys))
    if SUM + order in found:
        distinct, place, _ = merged(found[SUM + order])
        sums = summed(found[SUM + order], place, len(distinct))
        at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
        hit = distinct[at] == keys
        number[:, hit], den[hit] = sums[0][:, at[hit]], sums[1][at[hit]]
    return number, den


def by_kind(table: pa.Table) -> list[tuple[int, list[dict]]]:
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["g"], r["p"]))
    kinds = sorted({r["kind"] for r in rows})
    return [(k, [r for r in rows if r["kind"] == k]) for k in kinds]


def counts_of_counts(p: int, m: int, total: np.ndarray) -> tuple:
    """How many n-grams of order m have each count up to TOP + 1, all that they count, how many have one."""
    stats = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
    return p, -1, STATS + m, None, None, None, [*stats[: TOP + 2].tolist(), int(total.sum()), int((total > 0).sum())]


def _answers(mine: list[dict], at: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[tuple]:
    """A packet for each that asked, with its part of b (of whose rows there may be several) and c."""
    return [(r["p"], r["g"], r["kind"], planes(np.ascontiguousarray(b[..., lo:hi]).ravel()), planes(c[lo:hi]), None, None) for r, lo, hi in zip(mine, at[:-1], at[1:], strict=True)]


def _answer_range(key, table):
    """What the packets of a range add up to, for each that asked; counts also come with counts of counts."""
    p, out, found = key[0].as_py(), [], dict(by_kind(table))
    for kind, mine in found.items():
        if SUM < kind < WANT:
            continue
        if kind > STATS:
            out += [tuple(r[c] for c in NAMES) for r in mine]
            continue
        distinct, place, at = merged(mine)
        if kind > WANT:
            number, den = sums_of(kind - WANT, distinct, found)
            out += _answers(mine, at, number[:, place], den[place])
            continue
        total, first, flags = counted(mine, place, len(distinct))
        flags[first[first >= 0]] |= OWN
        out += _answers(mine, at, total[place], flags)
        out.append(counts_of_counts(p, kind - COUNT, total[distinct != BEGIN]))
    return packets(out)


def _relay(parts: int):
    """Adds the packets of a bunch of groups up and sends them on to the ranges of its bunch."""

    def run(key, table):
        g, out = (key[0].as_py() << 24) + key[1].as_py(), []
        for kind, mine in by_kind(table):
            if kind > STATS:
                out += [tuple(r[c] for c in NAMES) for r in mine]
                continue
            distinct, place, _ = merged(mine)
            if kind < SUM:
                held = np.bincount(place, np.concatenate([unplanes(r["c"], np.uint8) for r in mine])) > 0
                out += ask(g, kind, distinct, parts, counted(mine, place, len(distinct))[0], held.astype(np.uint8))
            else:
                out += ask(g, kind, distinct, parts, *(summed(mine, place, len(distinct)) if kind < WANT else ()))
        return packets(out)

    return run


def _give_back(key, asked, answered):
    """A relay's answers, for each group of the bunch."""
    out = []
    for kind, mine in by_kind(asked):
        if SUM < kind < WANT or kind > STATS:
            continue
        distinct, place, at = merged(mine)
        if kind > WANT:
            out += _answers(mine, at, answers(answered, kind, "a", np.int64, TOP + 1)[:, place], answers(answered, kind, "b", np.float64)[place])
            continue
        total, theirs = answers(answered, kind, "a", np.int64), answers(answered, kind, "b", np.uint8)
        _, first, flags = counted(mine, place, len(distinct))
        flags |= theirs[place] & np.uint8(SHARED | HELD)
        flags[first[(first >= 0) & (theirs & OWN > 0)]] |= OWN
        out += _answers(mine, at, total[place], flags)
    return packets(out)


def exchanged(asked: DataFrame, parts: int, wide: int, fanout: int, label: str) -> DataFrame:
    """The ranges' answers to the groups' packets, stored by kind. wide: ranges that groups send to, by relays if fewer than parts."""
    relays = wide < parts
    if relays:
        asked = stored(asked.withColumn("bunch", F.floor(F.col("g") / fanout).cast("int")), f"{label}-asked")
        sent = asked.groupBy("bunch", "p").applyInArrow(_relay(parts), PACKET)
    else:
        sent = asked
    found = sent.repartition(parts, "p").groupBy("p").applyInArrow(_answer_range, PACKET)
    if relays:
        found = stored(found, f"{label}-ranges")
        back = found.filter(F.col("kind") < STATS).withColumn("bunch", F.shiftright("g", 24).cast("int")).withColumn("wide", F.col("g").bitwiseAND((1 << 24) - 1))
        given = asked.groupBy("bunch", "p").cogroup(back.groupBy("bunch", "wide")).applyInArrow(_give_back, PACKET)
        found = given.unionByName(found.filter(F.col("kind") > STATS))
    return stored(found, label, "kind")


def discounts(n: list[int]) -> np.ndarray:
    """What part of a count r = 0..TOP Good-Turing leaves, from the counts of counts n[0..TOP+1].

    Where these are too few for a discount between 0 and 1, an absolute one stands in.
    """
    d = np.ones(TOP + 1)
    a = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        x = ((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) if n[r] and a < 1 else 0.0
        absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        d[r] = x if 0 < x < 1 else (r - min(absolute, 0.9)) / r
    return d


class Model:
    """Discounts and totals; a few numbers for each order. stats: counts of counts, tokens and kinds of each order."""

    def __init__(self, stats: dict[int, list[int]], order: int):
        zero = [0] * (TOP + 4)
        self.total, self.vocabulary = stats.get(1, zero)[-2:]
        self.d = {m: discounts(stats.get(m, zero)[: TOP + 2]) for m in range(1, order + 1)}
        r = np.arange(TOP + 1)
        lost = float((np.array(stats.get(1, zero)[1 : TOP + 1]) * r[1:] * (1 - self.d[1][1:])).sum())
        self.unknown = lost / self.total if self.total else 1.0
        self.scale = 1.0
        if self.unknown <= 0:  # nothing was discounted: one event more makes room for the unknown
            self.unknown, self.scale = 1 / (self.total + 1), self.total / (self.total + 1)

    def left(self, m: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= TOP, self.d[m][np.minimum(c, TOP)], 1.0) * c

    def word(self, c: np.ndarray) -> np.ndarray:
        """Probability of a word seen c times; all unseen words are one event."""
        return np.where(c > 0, self.scale * self.left(1, c) / max(self.total, 1), self.unknown)

    def share(self, m: int, c: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Discounted share of an n-gram of order m among the continuations of its context; 0 if it was not seen."""
        return self.left(m, c) / np.maximum(context, 1)

    def backoff(self, m: int, number: np.ndarray, den: np.ndarray, count: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scale of each context's shares of order m, and its backoff weight, from its sums, its count and its suffix's scale.

        The weight shares what the discounts left, exactly, among the words that never followed the context. Where
        nothing was discounted one event more is put aside.
        """
        num = number[0].astype(float)
        for r, left in enumerate(self.left(m, np.arange(1, TOP + 1)), 1):
            num += left * number[r]
        num /= np.maximum(count, 1)
        scale = np.where(num > 1 - 1e-9, count / (count + 1), 1.0)
        return scale, np.where(count > 0, (1 - scale * num) / np.maximum(1 - below * den, 1e-12), 1.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c.astype(float) + 1) / (self.total + self.vocabulary + 1))


class Known:
    """A group with the model's counts of its n-grams, and its own part of the sums for each context.

    number: how many of a context's continuations have each count up to TOP, and the sum of the greater counts; den:
    what their suffixes have in the order below. A group stands for its own n-grams. sends: contexts whose sums
    another may want; wants: contexts of others, too, whose sums it needs, for an n-gram that was not seen, or to tell
    whether nothing is discounted.
    """

    def __init__(self, group: Group, model: Model | None, counts: pa.Table | None, order: int, top: int):
        """With counts up to order, of a model of order top."""
        self.group, self.model, self.top = group, model, top
        self.asks, self.c, self.flags = {}, {}, {}
        for m in range(1, order + 1):
            asks = self.to_ask(m)
            c = np.zeros(len(asks), np.int64) if asks.all() else group.n(m)
            flags = np.where(c > 0, np.uint8(OWN), np.uint8(0))
            c[asks], flags[asks] = answers(counts, COUNT + m, "a", np.int64), answers(counts, COUNT + m, "b", np.uint8)
            self.asks[m], self.c[m], self.flags[m] = asks, c, flags
        flags = self.flags
        self.share = {1: model.word(self.c[1])} if order else {}
        self.number, self.den, self.far, self.sends, self.wants = {}, {}, {}, {}, {}
        for m in range(2, order + 1):
            context, suffix, c, size = group.context[m], group.suffix[m], self.c[m], self.c[m - 1]
            self.share[m] = model.share(m, c, size[context])
            own, n = np.flatnonzero(flags[m] & OWN), len(size)
            at, of = context[own].astype(np.int64), c[own]
            great = of > TOP
            number = np.bincount(at * (TOP + 1) + np.where(great, 0, of), minlength=n * (TOP + 1)).reshape(n, TOP + 1).T.copy()
            number[0] = np.bincount(at[great], of[great], n)
            self.number[m], self.den[m] = number, np.bincount(at, self.share[m - 1][suffix[own]], n)
            far = group.used(m - 1) & (size > 0) & (flags[m - 1] & SHARED > 0)
            unseen, some = np.zeros(n, bool), np.zeros(n, bool)
            unseen[context[c == 0]] = some[context[(c > 0) & (c <= TOP)]] = True
            whole = (size > TOP) & ~some
            self.far[m], self.wants[m] = far, far & (unseen | whole)
            self.sends[m] = far & ((flags[m - 1] & HELD > 0) | (size > TOP) | self.wants[m]) & (self.den[m] > 0)

    def to_ask(self, m: int) -> np.ndarray:
        """N-grams of order m that other groups may have: those whose parts others have, from order 3 on."""
        if m < 3:
            return np.ones(len(self.group.keys[m]), bool)
        shared = self.flags[m - 1] & SHARED > 0
        return shared[self.group.context[m]] & shared[self.group.suffix[m]]

    def ask_counts(self, m: int, g: int, parts: int) -> list[tuple]:
        """Packets of the n-grams of order m that others may have; counts of counts of the rest."""
        x, asks = self.group, self.to_ask(m)
        n = x.n(m)
        held = x.n(m, True) > 0 if m < self.top else np.zeros(len(n), bool)  # of contexts only
        return [*ask(g, COUNT + m, x.keys[m][asks], parts, n[asks], held[asks].astype(np.uint8)), counts_of_counts(g % parts, m, n[~asks])]

    def ask_sums(self, m: int, g: int, parts: int) -> list[tuple]:
        keys, sends = self.group.keys[m - 1], self.sends[m]
        out = ask(g, SUM + m, keys[sends], parts, self.number[m][:, sends], self.den[m][sends])
        return out + ask(g, WANT + m, keys[self.wants[m]], parts)

    def begun(self, sums: pa.Table, doc_id: pa.ChunkedArray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The documents' scores without what the wanted sums of the highest order add, and where these enter.

        From order to order: a seen n-gram has its share; one that was not seen has its suffix's probability times
        the context's backoff weight. A context whose sums are to come is a factor 1 here. (documents, contexts of the
        tokens that have such a one, in order, each twice the number among those wanted, plus 1 if the n-gram was seen;
        the contexts' counts; the scales of their suffixes' contexts.)
        """
        g, top = self.group, self.group.order
        p, scale, log, n = self.share[1], None, np.zeros(len(g.doc)), len(g.n_tokens)
        number_open, enters, size, below = np.zeros(n, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for m in range(2, top + 1):
            number, den, count, wants, context = self.number[m], self.den[m], self.c[m - 1], self.wants[m], g.context[m]
            number[:, self.far[m]], den[self.far[m]] = 0, 0  # of contexts that aren't wanted nothing is used
            if m < top:
                number[:, wants], den[wants] = answers(sums, WANT + m, "a", np.int64, TOP + 1), answers(sums, WANT + m, "b", np.float64)
            under = scale[g.suffix[m - 1]] if m > 2 else np.ones(len(count))
            scale, weight = self.model.backoff(m, number, den, count, under)
            if m == top:
                scale[wants] = weight[wants] = 1
                size, below = count[wants], under[wants]
            seen = self.c[m] > 0
            p = np.where(seen, scale[context] * self.share[m], weight[context] * p[g.suffix[m]])
            if m < top:
                short = np.flatnonzero(g.inside == m - 1)  # tokens with no longer history
                log[short] = np.log10(p[g.place[m][short]])
        long = np.flatnonzero(g.inside >= max(top - 1, 1))
        place = g.place[top][long]
        log[long] = np.log10(p)[place]
        if top > 1:
            number_of = np.where(wants, np.cumsum(wants) - 1, -1)
            enters = np.where(number_of[context] < 0, -1, 2 * number_of[context] + seen)[place]
            number_open = np.bincount(g.doc[long], enters >= 0, n).astype(np.int64)
            enters = enters[enters >= 0]
        real = np.flatnonzero(g.inside > 0)
        c, doc = self.c[1], g.doc[real]
        at = g.place[1][real]
        base, known = np.bincount(doc, self.model.base(c)[at], n), np.bincount(doc, (c > 0)[at], n).astype(np.int64)
        docs = [doc_id, *map(pa.array, (g.held, g.n_tokens, known, base, np.bincount(g.doc, log, n), number_open))]
        return pa.table(docs, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "open"]), enters, size, below

    def send_begun(self, g: int, parts: int, sums: pa.Table, doc_id: pa.ChunkedArray) -> list[tuple]:
        docs, enters, size, below = self.begun(sums, doc_id)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(docs)
        return [
            (g % parts, g, OPEN, planes(enters), planes(size), planes(below), None),
            (g % parts, g, DOCS, out.getvalue().to_pybytes(), None, None, None),
        ]


def ended(docs: pa.Table, model: Model) -> pa.Table:
    names = [x.split()[0] for x in RESULT.split(", ")]
    total = pa.array(np.full(len(docs), model.total))
    return docs.append_column("train_tokens", total).select(names)


def end(table: pa.Table, model: Model, order: int) -> pa.Table:
    """A group's scores from what it had begun, and the sums that it wanted of the highest order."""
    kind = table["kind"].to_pylist()
    docs = pa.ipc.open_stream(table["a"][kind.index(DOCS)].as_py()).read_all()
    enters, size, below = (unplanes(table[c][kind.index(OPEN)].as_py(), t) for c, t in (("a", np.int64), ("b", np.int64), ("c", np.float64)))
    number, den = answers(table, WANT + order, "a", np.int64, TOP + 1), answers(table, WANT + order, "b", np.float64)
    scale, weight = model.backoff(order, number, den, size, below)
    factors = np.log10(np.stack([weight, scale], 1).ravel())
    doc = np.repeat(np.arange(len(docs)), docs["open"].to_numpy())
    score = docs["score"].to_numpy() + np.bincount(doc, factors[enters], len(docs))
    return ended(docs.set_column(docs.schema.get_field_index("score"), "score", pa.array(score)), model)


def katz_scores(
    docs: DataFrame, held_out, order: int = ORDER, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """Scores of all texts under a Katz model of the order, learned from those that held_out (a column) leaves.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is empty and still has
    its end token; null held_out is false; without training texts every token is the one unknown event (score 0).
    Equal rows each get their row; very long texts are a group of their own size; other columns of docs, whatever
    their names, play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, parts = max(1, -(-size // group_bytes)), max(1, -(-size // range_bytes))
    # With relays, a group sends to ranges that are each a whole number of the last ones.
    wide = parts if parts <= fanout else fanout
    parts = parts if wide == parts else -(-parts // wide) * wide
    place = F.monotonically_increasing_id()
    block = F.xxhash64(F.spark_partition_id(), F.shiftright(place, 5))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.pmod(block, F.lit(groups)).alias("g"),
    )
    # Bucketed by group: as many passes over the texts as there are orders need no shuffle of them.
    name, path = f"katz_texts_{uuid.uuid4().hex}", new_path(spark, "katz-texts")
    try:
        rows.write.bucketBy(min(2 * groups, 50_000), "g").option("path", path).option("compression", "zstd").saveAsTable(name)
        texts = spark.table(name)

        def ask(upto):
            """A round: counts of order upto + 1, sums of order upto; the first has the counts of orders 1 and 2, the last scores."""

            def first(key, table):
                x, g = Known(Group(table, min(2, order)), None, None, 0, order), key[0].as_py()
                return packets([r for m in x.group.keys for r in x.ask_counts(m, g, wide)])

            def later(key, left, right):
                if not len(left):
                    return packets([])
                x, g = Known(Group(left, min(upto + 1, order)), model, right, upto, order), key[0].as_py()
                more = x.ask_counts(upto + 1, g, wide) if upto < order else []
                sums = x.ask_sums(upto, g, wide)  # before scores are begun, which overwrites the group's own sums
                return packets([*more, *sums, *(x.send_begun(g, wide, right, left["doc_id"]) if upto == order else [])])

            return later if upto else first

        def read(kind, table):
            return table.filter(F.col("kind").between(kind, kind + 9))

        asked, found, by_order = texts.groupBy("g").applyInArrow(ask(0), PACKET), None, {}
        for upto in [*range(2, order + 1), None] if order > 1 else [None]:
            new = exchanged(asked, parts, wide, fanout, "katz-model")
            del asked
            release_shuffles(spark)
            stats = read(STATS, new).select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n"))
            for r in stats.orderBy("kind", "pos").collect():  # TOP + 4 numbers for each order
                by_order.setdefault(r["kind"] - STATS, []).append(r["n"])
            model = Model(by_order, order)
            found = new if found is None else found.unionByName(new)
            if upto:
                has = read(COUNT, found).unionByName(read(WANT, found)) if upto == order else read(COUNT, found)
                asked = texts.groupBy("g").cogroup(has.groupBy("g")).applyInArrow(ask(upto), PACKET)

        def score(key, table):
            return end(table, model, order)

        def score_words(key, left, right):
            x = Known(Group(left.select(["text", "held_out"]), 1), model, right, 1, 1)
            return ended(x.begun(right, left["doc_id"])[0], model)

        if order > 1:
            scores = new.filter((F.col("kind") == WANT + order) | (F.col("kind") >= OPEN)).groupBy("g").applyInArrow(score, RESULT)
        else:
            scores = texts.groupBy("g").cogroup(read(COUNT, found).groupBy("g")).applyInArrow(score_words, RESULT)
        return stored(scores, "katz-scores")
    finally:
        spark.sql(f"drop table if exists {name}")
        drop_path(spark, path)


def op1_katz_scores(spark, sf_dir: str) -> DataFrame:
    from marlstone.sources.tables import table

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return katz_scores(table(spark, sf_dir, "documents"), held)
