"""The chat store: requests in batches, each batch one transaction.

A transaction reads one version, decides every request on it by joins, and commits the rows it
changes as the version that follows. If another writer was faster, nothing of it is seen; it
decides again on what that writer left, so a check never rests on rows that have changed since.
Requests get a verdict each: `ok`, `conflict`, `not_found` or `error`; refused ones change
nothing. With `strict`, one refused request stops the whole batch with the matching exception.

Rows are kept in segments of changed rows; of a key the newest segment's row counts.
Segments are merged when there are `fanout`. Requests of one key given twice count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound
from . import chat
from .lexical import small
from .manifest import VersionLog
from .staging import remove, stored

SESSIONS = "user_id string, session_id string, session_name string, is_private boolean, is_deleted boolean, created_at timestamp"
MESSAGES = "session_id string, round_id long, role string, msg_id string, text string, feedback string, is_deleted boolean, created_at timestamp"
SCHEMAS = {"sessions": SESSIONS, "messages": MESSAGES}
KEYS = {"sessions": ["user_id", "session_id"], "messages": ["session_id", "round_id", "role"]}
UNTITLED = "Untitled Session"

Decision = tuple[DataFrame, dict[str, DataFrame]]


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, fanout: int = 8):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.log = VersionLog(spark, f"{self.path}/manifest")

    # -- reading
    def table(self, name: str, version: int | None = None) -> DataFrame:
        """sessions or messages as of a version, deleted rows included."""
        return self._of(self.log.entries(version), name)

    def _of(self, entries: list[dict], name: str) -> DataFrame:
        rows = None
        for k, e in enumerate(x for x in entries if name in x["tables"]):
            one = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/segments/{e['segment']}/{name}").withColumn("seg", F.lit(k))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rest = [c for c in rows.columns if c not in KEYS[name] and c != "seg"]
        newest = rows.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "seg").alias("x"))
        return newest.select(*KEYS[name], "x.*").select(*[c for c in rows.columns if c != "seg"])

    def listed(self, version: int | None = None) -> DataFrame:
        """Live sessions with `last_touched_at`: the last user message's time, or their creation's."""
        return touched(self.table("sessions", version), self.table("messages", version))

    # -- writing
    def _segment(self, rows: dict[str, DataFrame]) -> dict:
        made = {"segment": uuid.uuid4().hex[:16], "tables": sorted(rows)}
        for name, df in rows.items():
            kept = df.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema])
            kept.write.parquet(f"{self.path}/segments/{made['segment']}/{name}")
        return made

    def transact(self, decide: Callable[[Callable[[str], DataFrame]], Decision], strict: bool = False) -> DataFrame:
        """decide(read) gives (verdicts, changed rows by table) from read(table name), all of one version; the verdicts of the
        run that was committed. decide may run more than once."""
        while True:
            version = self.log.version()
            entries = self.log.entries(version)
            verdicts, rows = decide(lambda name: self._of(entries, name))
            verdicts = stored(verdicts)
            counts = {r["status"]: r["count"] for r in verdicts.groupBy("status").count().collect()}
            refused = verdicts.where("status <> 'ok'").first() if strict and set(counts) - {"ok"} else None
            if refused is not None:
                raise {"conflict": Conflict, "not_found": NotFound}.get(refused["status"], RuntimeError)(str(refused.asDict()))
            if not counts.get("ok"):
                return verdicts
            made = self._segment(rows)
            if self.log.commit([*entries, made], version):
                if len(entries) + 1 >= self.fanout:
                    self.merge()
                return verdicts
            remove(self.spark, f"{self.path}/segments/{made['segment']}")

    def put(self, **rows: DataFrame) -> int:
        """Rows as they are, of either table: loads and imports."""
        made = self._segment(rows)
        return self.log.update(lambda now: [*now, made])

    def merge(self) -> int:
        """All segments as one; what others added meanwhile stays behind it."""
        old = self.log.entries()
        made = self._segment({name: self._of(old, name) for name in SCHEMAS if any(name in e["tables"] for e in old)})
        version = self.log.update(lambda now: [made, *now[len(old):]] if now[: len(old)] == old else None)
        if made not in self.log.entries(version):
            remove(self.spark, f"{self.path}/segments/{made['segment']}")
        return version

    # -- requests
    def create(self, requests: DataFrame, most: int = 10, strict: bool = False) -> DataFrame:
        """requests: (user_id, session_id, session_name, created_at, known array, victim). `known`, the ids the client believes live,
        must be the live ones; with `most` live, the victim must be the one touched longest ago, and goes; with more, an error.
        One request a user and batch can be right: the smallest session_id's."""
        asked = stored(requests.dropDuplicates(KEYS["sessions"]))

        def decide(read) -> Decision:
            every = read("sessions")
            mine = stored(touched(every, read("messages")).join(small(asked.select("user_id").distinct()), "user_id", "left_semi"))
            per = mine.groupBy("user_id").agg(F.count("*").alias("n_live"), F.min_by("session_id", F.struct("last_touched_at", "session_id")).alias("oldest"))
            known = asked.select(*KEYS["sessions"], F.explode_outer(F.array_distinct("known")).alias("id"))
            met = known.join(mine.select("user_id", F.col("session_id").alias("id"), F.lit(1).alias("hit")), ["user_id", "id"], "left")
            met = met.groupBy(*KEYS["sessions"]).agg(F.count("id").alias("n_known"), F.count("hit").alias("n_met"))
            first = asked.groupBy("user_id").agg(F.min("session_id").alias("first"))
            there = every.join(small(asked.select(*KEYS["sessions"])), KEYS["sessions"], "left_semi").select(*KEYS["sessions"], F.lit(True).alias("there"))
            n = F.coalesce("n_live", F.lit(0))
            status = (F.when(F.col("there") | (F.col("session_id") != F.col("first")) | (F.col("n_known") != n) | (F.col("n_met") != n), "conflict")
                      .when(n > most, "error").when((n == most) & ~F.col("victim").eqNullSafe(F.col("oldest")), "conflict").otherwise("ok"))
            judged = asked.join(per, "user_id", "left").join(met, KEYS["sessions"]).join(first, "user_id").join(there, KEYS["sessions"], "left").withColumn("status", status).withColumn("full", n == most)
            judged = stored(judged)
            new = judged.where("status = 'ok'").select(*KEYS["sessions"], "session_name", F.lit(False).alias("is_private"), F.lit(False).alias("is_deleted"), "created_at")
            gone = judged.where("status = 'ok' AND full").select("user_id", F.col("victim").alias("session_id"))
            gone = every.join(small(gone), KEYS["sessions"], "left_semi").withColumn("is_deleted", F.lit(True))
            return judged.select(*KEYS["sessions"], "status"), {"sessions": new.unionByName(gone)}

        return self.transact(decide, strict)

    def update(self, requests: DataFrame, fields: tuple[str, ...] = ("session_name",), strict: bool = False) -> DataFrame:
        """requests: (user_id, session_id, before_<field>..., after_<field>...): the live session's fields must be as before, else a conflict."""
        asked = stored(requests.dropDuplicates(KEYS["sessions"]))

        def decide(read) -> Decision:
            live = read("sessions").where(~F.col("is_deleted"))
            same = F.lit(True)
            for f in fields:
                same = same & F.col(f).eqNullSafe(F.col(f"before_{f}"))
            judged = stored(asked.join(live, KEYS["sessions"], "left").withColumn("status", F.when(F.col("is_deleted").isNull(), "not_found").when(~same, "conflict").otherwise("ok")))
            return judged.select(*KEYS["sessions"], "status"), {"sessions": judged.where("status = 'ok'").withColumns({f: F.col(f"after_{f}") for f in fields})}

        return self.transact(decide, strict)

    def set_titles(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """requests: (user_id, session_id, title): only where the name is still the default; trimmed, 30 characters at most, never blank."""
        asked = stored(requests.dropDuplicates(KEYS["sessions"]))

        def decide(read) -> Decision:
            title = F.substring(F.nullif(F.trim("title"), F.lit("")), 1, 30)
            judged = asked.join(read("sessions").where(~F.col("is_deleted")), KEYS["sessions"], "left").withColumn("title", title)
            judged = stored(judged.withColumn("status", F.when(F.col("is_deleted").isNull(), "not_found").when((F.col("session_name") != UNTITLED) | F.col("title").isNull(), "conflict").otherwise("ok")))
            return judged.select(*KEYS["sessions"], "status"), {"sessions": judged.where("status = 'ok'").withColumn("session_name", F.col("title"))}

        return self.transact(decide, strict)

    def claim(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """requests: (session_id, round_id, msg_id, text, created_at): a round's user message, deleted until the round is finished; a conflict if it is there."""
        key = ["session_id", "round_id"]
        asked = stored(requests.dropDuplicates(key))

        def decide(read) -> Decision:
            there = read("messages").where("role = 'user'").select(*key, F.lit(True).alias("there"))
            judged = stored(asked.join(there, key, "left").withColumn("status", F.when(F.col("there"), "conflict").otherwise("ok")))
            new = judged.where("status = 'ok'").select(*key, F.lit("user").alias("role"), "msg_id", "text", F.lit(None).cast("string").alias("feedback"), F.lit(True).alias("is_deleted"), "created_at")
            return judged.select(*key, "status"), {"messages": new}

        return self.transact(decide, strict)

    def finalize(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """requests: (session_id, round_id, role system or assistant, msg_id, text, created_at). A round's messages are added and its user
        message comes alive together; not_found without a claimed user message, a conflict if it is live or an answer is there."""
        key = ["session_id", "round_id"]
        asked = stored(requests.dropDuplicates(KEYS["messages"]))

        def decide(read) -> Decision:
            every = read("messages")
            rounds = asked.select(*key).distinct()
            mine = stored(every.join(small(rounds), key, "left_semi"))
            state = mine.groupBy(*key).agg(F.max(F.when(F.col("role") == "user", ~F.col("is_deleted"))).alias("live"), F.max(F.col("role") != "user").alias("answered"))
            judged = stored(rounds.join(state, key, "left").withColumn("status", F.when(F.col("live").isNull(), "not_found").when(F.col("live") | F.col("answered"), "conflict").otherwise("ok")))
            good = small(judged.where("status = 'ok'").select(*key))
            answers = asked.join(good, key, "left_semi").select(*KEYS["messages"], "msg_id", "text", F.lit(None).cast("string").alias("feedback"), F.lit(False).alias("is_deleted"), "created_at")
            alive = mine.join(good, key, "left_semi").withColumn("is_deleted", F.lit(False))
            return judged.select(*key, "status"), {"messages": answers.unionByName(alive)}

        return self.transact(decide, strict)

    def delete_rounds(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """requests: (session_id, round_id): the round's live messages; not_found if there are none."""
        return self._patch(requests, F.lit(True), {"is_deleted": F.lit(True)}, strict)

    def patch_feedback(self, requests: DataFrame, strict: bool = False) -> DataFrame:
        """requests: (session_id, round_id, feedback good or bad): the round's assistant messages; not_found if there are none, an error for other words."""
        return self._patch(requests.withColumnRenamed("feedback", "new"), F.col("role") == "assistant", {"feedback": F.col("new")}, strict, F.coalesce(F.col("new").isin("good", "bad"), F.lit(False)), deleted=True)

    def _patch(self, requests: DataFrame, which, change: dict, strict: bool, valid=None, deleted: bool = False) -> DataFrame:
        key = ["session_id", "round_id"]
        asked = stored(requests.dropDuplicates(key))

        def decide(read) -> Decision:
            rows = read("messages").where(which if deleted else which & ~F.col("is_deleted"))
            hit = stored(rows.join(small(asked), key))
            found = hit.select(*key).distinct().withColumn("found", F.lit(True))
            status = F.when(F.lit(True) if valid is None else valid, F.when(F.col("found"), "ok").otherwise("not_found")).otherwise("error")
            judged = stored(asked.join(found, key, "left").withColumn("status", status))
            good = small(judged.where("status = 'ok'").select(*key))
            return judged.select(*key, "status"), {"messages": hit.join(good, key, "left_semi").withColumns(change)}

        return self.transact(decide, strict)


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Live sessions with `last_touched_at`."""
    live = sessions.where(~F.col("is_deleted"))
    return chat.last_touched(live, messages.where("role = 'user' AND NOT is_deleted").select("session_id", F.col("created_at").alias("at")), ["session_id"], "created_at", "at")
