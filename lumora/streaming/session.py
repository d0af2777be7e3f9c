"""Leaders of unknown faces as the state of a stream: a face joins the leader that an earlier batch, or an earlier run, has set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumora.operators.detect import FACE_LEADER

#: The state store that keyed state with a time to live needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPSILON = 1e-8


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors of one length as rows; others are rows of zeros, which are like nothing."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[k] = v
    return np.nan_to_num(out)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt(np.einsum("ij,ij->i", a, a))[:, None] * np.sqrt(np.einsum("ij,ij->i", b, b)) + EPSILON)


class Leaders(StatefulProcessor):
    """A session's leaders, in the order in which they came. A leader that is joined lives on for another `ttl_ms`."""

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = T.StructType([T.StructField("place", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
        self.leaders = handle.getMapState("leaders", T.StructType([T.StructField("id", T.LongType())]), value, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        faces = pd.concat(list(rows)).sort_values("id", kind="stable")  # one session's rows of one micro-batch
        held = sorted((value[0], k[0], value[1]) for k, value in self.leaders.iterator())
        place = held[-1][0] + 1 if held else 0
        width = max([len(v) for v in faces["vec"] if v is not None] + [len(h[2]) for h in held], default=0)
        x, old = _matrix(list(faces["vec"]), width), _matrix([h[2] for h in held], width)
        known, names = [], [h[1] for h in held]
        met = _cosines(x, old) if len(held) else np.zeros((len(x), 0))
        out, used = [], set()
        for k, face in enumerate(faces["id"].tolist()):
            s = np.concatenate([met[k], _cosines(x[k : k + 1], x[known])[0] if known else np.zeros(0)])
            best = int(s.argmax()) if len(s) else -1  # ties go to the earlier leader
            if best >= 0 and s[best] > self.threshold:
                out.append((face, names[best], float(s[best])))
                used.add(best)
            else:
                known.append(k)
                names.append(face)
                out.append((face, face, None))
        for k in sorted(used):
            if k < len(held):
                self.leaders.updateValue((held[k][1],), (held[k][0], held[k][2]))
        for n, k in enumerate(known):
            self.leaders.updateValue((names[len(held) + n],), (place + n, x[k].tolist()))
        yield pd.DataFrame({"session": key[0], "id": [o[0] for o in out], "leader": [o[1] for o in out], "score": [o[2] for o in out]}).astype({"score": "float64"})

    def close(self) -> None:
        pass


def session_leaders(faces: DataFrame, threshold: float = FACE_LEADER, ttl_ms: int | None = None) -> DataFrame:
    """A stream of faces (session, id, vec) with their leaders: session, id, leader, score (null for leaders).

    Within a session the order of arrival decides, batch by batch, by id within a batch; so a session is one task's work, and sessions
    spread. The leaders lie in the state store, below the query's checkpoint, and survive a restart; one that nobody joined for ttl_ms
    goes. In the order of ids, over any number of batches, that gives what detect.leaders gives for all faces at once.
    """
    out = T.StructType([T.StructField("session", faces.schema["session"].dataType), T.StructField("id", T.LongType()), T.StructField("leader", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = faces.where("id is not null").selectExpr("session", "cast(id as long) as id", "cast(vec as array<double>) as vec")
    return rows.groupBy("session").transformWithStateInPandas(Leaders(threshold, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime")


def prepared(spark: SparkSession) -> SparkSession:
    """Sets the state store that session_leaders needs, for streams started after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
