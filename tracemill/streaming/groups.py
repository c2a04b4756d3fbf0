"""Groups that are emitted once they are full, from a stream of rollouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "instance_id string, n int, n_filled int, items array<string>"
STATE = "items array<string>"


def full_groups(rollouts: DataFrame, size: int) -> DataFrame:
    """One row for each group of `size` rollouts or more of which as many have text, as soon as it is full.

    rollouts is a stream with instance_id and content. A group that was emitted starts anew; one that
    never fills is kept without end, as nothing expires.
    """

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in parts:
            held += [c or "" for c in pdf["content"]]
        filled = sum(1 for c in held if c.strip())
        if len(held) >= size and filled >= size:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], len(held), filled, held)], columns=["instance_id", "n", "n_filled", "items"])
        else:
            state.update((held,))

    return rollouts.groupBy("instance_id").applyInPandasWithState(take, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
