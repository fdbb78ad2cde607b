"""Templates of a stream: one miner for each count of tokens, kept as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.templates import Miner, n_tokens


def mine_stream(messages: DataFrame, similarity: float = 0.4, depth: int = 4) -> DataFrame:
    """From a stream of (seq, message): seq, cluster (unique with n_tokens), template, change_type. Within a batch
    the messages of a group are taken in order of seq; batches in order of arrival."""

    def work(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        miner = pickle.loads(state.get[0]) if state.exists else Miner(similarity, depth)
        rows = pd.concat(list(parts)).sort_values("seq")
        found = [miner.add(m) for m in rows["message"]]
        state.update((pickle.dumps(miner),))
        yield pd.DataFrame({"n_tokens": key[0], "seq": rows["seq"].to_numpy(), "cluster": [f[0] for f in found], "template": [f[1] for f in found], "change_type": [f[2] for f in found]})

    keyed = messages.where("message is not null").select("seq", "message", n_tokens(F.col("message")).alias("n_tokens"))
    return keyed.groupBy("n_tokens").applyInPandasWithState(work, "n_tokens int, seq long, cluster long, template string, change_type string", "miner binary", "append", GroupStateTimeout.NoTimeout)
