"""Missing materials filled in rounds: diagnose, plan, act, diagnose again, until a round changes nothing."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.dossier import MATERIALS, TOPIC_MATERIALS
from marlstone.operators.research import missing
from marlstone.storage import stored

#: The order in which actions run, and the actions that can fill a material.
ORDER = ["deep", "spa", "third_party", "raises", "hacks", "ai_classify", "tokenomics", "holders", "social", "unlocks"]
CLASSIFIED = ["deep", "spa", "ai_classify"]
FILLED_BY = {
    "official_website": ["deep", "spa"], "whitepaper": ["deep", "spa"], "github": ["deep", "spa"], "audit": ["deep", "third_party"], "tokenomics": ["tokenomics"], "holders": ["holders"],
    "social_heat": ["social"], "unlocks": ["unlocks"], "contract": ["deep"], **dict.fromkeys(TOPIC_MATERIALS.values(), CLASSIFIED),
    "tge_ido": [*CLASSIFIED, "raises"], "onchain_incident": [*CLASSIFIED, "hacks"], "third_party_rating": [*CLASSIFIED, "third_party"],
}
#: An action: the gaps that it may fill (asset_id, material) and the round's number to what it found (asset_id, material).
Action = Callable[[DataFrame, int], DataFrame]
#: What an action raises when its source does not answer.
DOWN = (ConnectionError, TimeoutError)


class Unfinished(RuntimeError):
    """Rounds ended although an action had failed or not run, or the last one still closed gaps."""


def plan(gaps: DataFrame) -> DataFrame:
    """asset_id, step, action and materials (sorted): what an asset's gaps need, in the order in which it runs."""
    table = F.create_map(*[x for m, actions in FILLED_BY.items() for x in (F.lit(m), F.array(*map(F.lit, actions)))])
    rows = gaps.select("asset_id", "material", F.explode(F.element_at(table, F.col("material"))).alias("action"))
    step = F.array_position(F.array(*map(F.lit, ORDER)), F.col("action")).cast("int")
    return rows.groupBy("asset_id", step.alias("step"), "action").agg(F.array_sort(F.collect_set("material")).alias("materials"))


def fill_until_done(assets: DataFrame, have: DataFrame, actions: dict[str, Action], materials: list[str] = MATERIALS, rounds: int = 200, least_pending: int = 1, least_new: int = 1, seconds: float = 1800.0) -> tuple[DataFrame, DataFrame]:
    """(have, report): what the assets have after the rounds, and round, action, targets, closed, pending and error of each action.

    A round diagnoses the gaps, runs each action on the gaps that it may fill and that earlier actions of the round left,
    and writes what was found, so a lost executor costs a re-read. It ends before a round with fewer gaps than
    least_pending, after one that closed fewer than least_new, and after rounds. An action whose source is down (DOWN)
    is reported and does not stop the others; one that starts later than seconds after its round began is left to the
    next round. Any other failure, of an action or of the engine, is raised. Rounds that ended with a failure or too
    early return what there is: whole tells.
    What an action finds beyond its targets is no gap and is left out. The report is a row for each action and round.
    """
    assets = assets.select("asset_id").distinct()
    have = stored(have.select("asset_id", "material").distinct(), "fill-have")
    done: list[tuple] = []
    for number in range(1, rounds + 1):
        # Gaps meet what was found by a shuffle: a broadcast in each of so many rounds and actions would pass through the driver.
        gaps = stored(missing(assets, have, materials), "fill-gaps")
        left = Counter({r.material: r["count"] for r in gaps.groupBy("material").count().collect()})  # a number for each material
        closed, began = 0, time.monotonic()
        if left.total() < least_pending:
            break
        for name in ORDER:
            wanted = [m for m in materials if name in FILLED_BY[m] and left[m]]
            if name not in actions or not wanted:
                continue
            n = sum(left[m] for m in wanted)
            if time.monotonic() - began > seconds:
                done.append((number, name, n, 0, left.total(), "round out of time"))
                continue
            targets = gaps.filter(F.col("material").isin(wanted))
            try:
                found = actions[name](targets, number)
            except DOWN as e:  # the gaps stay
                done.append((number, name, n, 0, left.total(), f"{type(e).__name__}: {e}"[:200]))
                continue
            found = stored(found.select("asset_id", "material").distinct().join(targets.hint("merge"), ["asset_id", "material"], "left_semi"), f"fill-{name}")
            new = Counter({r.material: r["count"] for r in found.groupBy("material").count().collect()})
            if new:
                have, gaps = have.unionByName(found), gaps.join(found.hint("merge"), ["asset_id", "material"], "left_anti")
                left, closed = left - new, closed + new.total()
            done.append((number, name, n, new.total(), left.total(), None))
        have = stored(have, "fill-have")
        if closed < least_new:
            break
    return have, assets.sparkSession.createDataFrame(done, "round int, action string, targets long, closed long, pending long, error string")


def whole(have: DataFrame, report: DataFrame, least_pending: int = 1, least_new: int = 1) -> tuple[DataFrame, DataFrame]:
    """have and report as they are, if a last round without a failure changed nothing or left nothing; else Unfinished is raised.

    A failure in an earlier round is no loss: its gaps were there in the rounds after.
    """
    last = report.join(report.agg(F.max("round").alias("round")), "round").orderBy("action").collect()  # a row for each action
    failed = [f"{r.action}: {r.error}" for r in last if r.error]
    if failed:
        raise Unfinished(f"round {last[0]['round']} ended with {'; '.join(failed)}")
    if last and sum(r.closed for r in last) >= least_new and min(r.pending for r in last) >= least_pending:
        raise Unfinished(f"round {last[0]['round']} was the last and still closed gaps")
    return have, report
