"""What changed, as a stream: the state of each key is the hash it was last seen with and when; a timer tells that it is gone.

The state store takes the place of a manifest: a batch meets the state of its own keys only, so nothing is compared with
all that is known, and keys that do not come again are told by event time. Keys are dealt to groups by a hash, and a group's
keys are followed together in columns: there is a call for each group and batch, not for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merchlake.operators.entities import content_hash

#: Groups that keys are dealt to. A group's state is written anew when one of its keys comes; a checkpoint keeps its number.
GROUPS = 512
_MS = 1000
_STATE = ["key", "hash", "seen", "due"]


def changes(stream: DataFrame, key: str, time: str, stable: list[str], gone_after_s: int, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(key, at, status): every sighting of a key as added, updated or unchanged, and removed once it has not been seen for longer than `gone_after_s`.

    `time` is a timestamp; a sighting is unchanged if the columns `stable` are those of the one before, and added if there is
    none or the key was removed since. `at` of a removal is the last sighting plus `gone_after_s`. A removal comes out when
    the watermark, `late` behind the latest time, has passed that, or before a later sighting of the key. Sightings of one
    key in a batch are taken in order of time; one that is older than the last goes by its content alone and leaves the time.
    Nulls in `key` or `time` are no sightings.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"), content_hash(*stable).alias("hash"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    kind = stream.schema[key].dataType.simpleString()
    gone_after = gone_after_s * _MS

    def follow(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        old = pd.DataFrame(dict(zip(_STATE, state.get, strict=True))) if state.exists else None
        new = None if state.hasTimedOut else pd.concat([b[["key", "ms", "hash"]] for b in batches], ignore_index=True)
        out, left = [], []
        if old is not None:
            rest = old if new is None else old[~old["key"].isin(new["key"])]
            late_ones = rest["due"] < now
            out.append(pd.DataFrame({"key": rest["key"], "ms": rest["seen"] + gone_after, "status": "removed"})[late_ones])
            left.append(rest[~late_ones])
        if new is not None:
            new["known"] = 1
            if old is not None:  # what is known of a key stands before its sightings
                known = old[old["key"].isin(new["key"])].rename(columns={"seen": "ms"})[["key", "ms", "hash"]].assign(known=0)
                new = pd.concat([known, new], ignore_index=True) if len(known) else new
            new = new.sort_values(["key", "known", "ms", "hash"], ignore_index=True)
            new["seen"] = new.groupby("key", sort=False)["ms"].cummax()
            first = new["key"] != new["key"].shift()
            before, same = new["seen"].shift(fill_value=0), new["hash"] == new["hash"].shift()
            gone = ~first & (new["ms"] - before > gone_after)
            new["status"] = same.map({True: "unchanged", False: "updated"}).mask(first | gone, "added")
            out.append(pd.DataFrame({"key": new["key"], "ms": before + gone_after, "status": "removed"})[gone & (new["known"] == 1)])
            out.append(new.loc[new["known"] == 1, ["key", "ms", "status"]])
            last = new[new["key"] != new["key"].shift(-1)]
            left.append(last.assign(due=(last["seen"] + gone_after).clip(lower=now + 1))[_STATE])
        left = pd.concat(left, ignore_index=True)
        if len(left):
            state.update(tuple(left[n].tolist() for n in _STATE))
            state.setTimeoutTimestamp(max(int(left["due"].min()), now + 1))
        elif state.exists:
            state.remove()
        yield pd.concat(out, ignore_index=True)

    lists = f"key array<{kind}>, hash array<string>, seen array<long>, due array<long>"
    out = rows.groupBy("group").applyInPandasWithState(follow, f"key {kind}, ms long, status string", lists, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_millis("ms").alias("at"), "status")
