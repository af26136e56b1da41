"""Chat store: relational operators over session and message snapshots, all sessions at once.

messages: (conv_id, turn, role, text[, is_deleted, feedback]); every write returns a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound

ROLE_ORDER = {"user": 0, "assistant": 1, "system": 2}


def role_order(role: Column) -> Column:
    out = F.lit(99)
    for name, k in ROLE_ORDER.items():
        out = F.when(role == name, k).otherwise(out)
    return out


def with_rounds(messages: DataFrame) -> DataFrame:
    """round_id: user messages so far, from 0; what comes before the first user message is round 0."""
    users = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("round_id", F.greatest(users - 1, F.lit(0)).cast("long"))


def in_order(messages: DataFrame) -> DataFrame:
    """Adds `place`, from 0, in each session: by round, then user, assistant, system, others, then turn."""
    order = Window.partitionBy("conv_id").orderBy("round_id", role_order(F.col("role")), "turn")
    return messages.withColumn("place", F.row_number().over(order) - 1)


def count_rounds(messages: DataFrame) -> DataFrame:
    """(conv_id, n_rounds)."""
    return messages.groupBy("conv_id").agg(F.countDistinct("round_id").alias("n_rounds"))


def newest_first(sessions: DataFrame, user: str, session: str, at: str) -> DataFrame:
    """Adds `place`, from 0: each user's sessions, the last touched first."""
    return sessions.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), session)) - 1)


# Fixed values of the request format.
MODES = ("RAG (Pro Mode)", "RAG (Standard)", "No RAG")


def parse_requests(df: DataFrame, column: str = "payload", modes: tuple[str, ...] = MODES) -> DataFrame:
    """Request bodies (JSON) to typed columns beside the others, and `valid`: ids as text, round_id as a whole number, messages
    as a JSON array, rag_mode one of `modes` (the first if absent), use_reranker as truth, a blank title as null."""
    body = F.try_parse_json(F.col(column))
    get = lambda name, kind: F.try_variant_get(body, f"$.{name}", kind)
    ids = ["user_msg_id", "system_msg_id", "assistant_msg_id"]
    has_mode = F.try_variant_get(body, "$.rag_mode", "variant").isNotNull()
    mode = F.when(has_mode, get("rag_mode", "string")).otherwise(F.lit(modes[0]))
    out = df.select(*[c for c in df.columns if c != column], *[get(i, "string").alias(i) for i in ids], get("round_id", "int").alias("round_id"), get("messages", "array<variant>").alias("__m"), mode.alias("rag_mode"),
                    F.coalesce(get("use_reranker", "boolean"), F.lit(False)).alias("use_reranker"), F.nullif(F.trim(get("database_title", "string")), F.lit("")).alias("database_title"))
    valid = F.col("__m").isNotNull() & F.col("round_id").isNotNull() & F.coalesce(F.col("rag_mode").isin(*modes), F.lit(False))
    for i in ids:
        valid = valid & F.col(i).isNotNull()
    return out.withColumn("n_messages", F.size("__m")).withColumn("valid", valid).drop("__m")


def last_touched(sessions: DataFrame, messages: DataFrame, key: list[str], created: str, at: str) -> DataFrame:
    """Live sessions with their last live user message's time, or their creation's."""
    last = messages.groupBy(*key).agg(F.max(at).alias("__last"))
    return sessions.join(last, key, "left").withColumn("last_touched_at", F.coalesce("__last", created)).drop("__last")


def history_page(messages: DataFrame, n: int = 10) -> DataFrame:
    """Messages of the newest n rounds of each session, deleted ones included, and has_more."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be from 1 to 1000")
    of = Window.partitionBy("conv_id")
    ranked = messages.withColumn("__r", F.dense_rank().over(of.orderBy(F.desc("round_id"))))
    return ranked.withColumn("has_more", F.max("__r").over(of) > n).where(F.col("__r") <= n).drop("__r")


def last_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n live messages of each session."""
    live = messages.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in messages.columns else messages
    return live.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__r") <= n).drop("__r")


def next_round(messages: DataFrame) -> DataFrame:
    """(conv_id, next_round_id)."""
    return messages.groupBy("conv_id").agg((F.coalesce(F.max("round_id"), F.lit(-1)) + 1).alias("next_round_id"))


def pivot_rounds(messages: DataFrame) -> DataFrame:
    """One row per round: user, assistant and system text (the first by turn)."""
    text = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn"))).alias(f"{role}_text")
    return messages.groupBy("conv_id", "round_id").agg(*map(text, ROLE_ORDER))


def soft_delete(messages: DataFrame, rounds: DataFrame, strict: bool = False) -> DataFrame:
    """is_deleted for the live messages of these (conv_id, round_id); strict: NotFound if there are none."""
    flagged = messages if "is_deleted" in messages.columns else messages.withColumn("is_deleted", F.lit(False))
    hit = flagged.join(rounds.select("conv_id", "round_id").distinct().withColumn("__hit", F.lit(True)), ["conv_id", "round_id"], "left")
    if strict and hit.where("__hit and not is_deleted").isEmpty():
        raise NotFound("no live message in these rounds")
    return hit.withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def patch_feedback(messages: DataFrame, patches: DataFrame, strict: bool = False) -> DataFrame:
    """patches: (conv_id, feedback good or bad, one per session); assistant messages only. strict: NotFound if a session has none."""
    bad = patches.where(~F.col("feedback").isin("good", "bad")).first()
    if bad:
        raise ValueError(f"feedback must be good or bad, not {bad['feedback']!r}")
    again = patches.groupBy("conv_id").count().where("count > 1").first()
    if again:
        raise ValueError(f"several patches for session {again['conv_id']!r}")
    if strict and not patches.join(messages.where("role = 'assistant'"), "conv_id", "left_anti").isEmpty():
        raise NotFound("no assistant message to patch")
    old = F.col("feedback_old") if "feedback" in messages.columns else F.lit(None).cast("string")
    base = messages.withColumnRenamed("feedback", "feedback_old")
    return (base.join(patches.select("conv_id", F.col("feedback").alias("__new")), "conv_id", "left")
            .withColumn("feedback", F.when((F.col("role") == "assistant") & F.col("__new").isNotNull(), F.col("__new")).otherwise(old)).drop("__new", "feedback_old"))


def oldest(sessions: DataFrame, user: str, session: str, at: str) -> DataFrame:
    """Each user's oldest session and number of sessions."""
    return sessions.groupBy(user).agg(F.min_by(session, F.struct(at, session)).alias("oldest_session"), F.count("*").alias("n_sessions"))


def limit_violations(sessions: DataFrame, user: str, session: str, at: str, most: int = 10) -> DataFrame:
    """Users at or above the limit, with the session that must go first."""
    return oldest(sessions, user, session, at).where(F.col("n_sessions") >= most).withColumn("over_limit", F.col("n_sessions") > most)


def create_session(sessions: DataFrame, new: DataFrame, known: list[str], victim: str | None = None, most: int = 10) -> DataFrame:
    """Snapshot with one user's new session. known: the ids the client believes live; at the limit, victim must be the oldest and goes."""
    user = new.first()["user_id"]
    live = {r["session_id"]: r["last_touched_at"] for r in sessions.where((F.col("user_id") == user) & ~F.col("is_deleted")).select("session_id", "last_touched_at").limit(most + 2).collect()}
    if set(known) != set(live):
        raise Conflict("the client's sessions are not the stored ones")
    if len(live) > most:
        raise RuntimeError(f"more than {most} live sessions")
    if len(live) == most:
        if victim != min(live, key=lambda k: (live[k], k)):
            raise Conflict("only the oldest session can make room")
        sessions = sessions.withColumn("is_deleted", F.col("is_deleted") | ((F.col("user_id") == user) & (F.col("session_id") == victim)))
    return sessions.unionByName(new)


def update_session(sessions: DataFrame, key: dict, before: dict, after: dict) -> DataFrame:
    """Compare and set on one live session."""
    mine = ~F.col("is_deleted")
    for k, v in key.items():
        mine = mine & (F.col(k) == v)
    row = sessions.where(mine).first()
    if row is None:
        raise NotFound(str(key))
    if any(row[k] != v for k, v in before.items()):
        raise Conflict(str(key))
    return sessions.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in after.items()})


def claim_round(messages: DataFrame, placeholder: DataFrame) -> DataFrame:
    """Insert a round's deleted placeholder; Conflict if its unique key exists."""
    key = ["conv_id", "round_id", "role"]
    if not placeholder.join(messages, key, "left_semi").isEmpty():
        raise Conflict("the round is taken")
    return messages.unionByName(placeholder)


def finalize_round(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """One snapshot: the rounds' placeholders come alive, their system and assistant messages are added."""
    done = answers.select("conv_id", "round_id").distinct().withColumn("__done", F.lit(True))
    alive = messages.join(done, ["conv_id", "round_id"], "left").withColumn("is_deleted", F.col("is_deleted") & ~F.coalesce("__done", F.lit(False))).drop("__done")
    return alive.unionByName(answers)


def set_title(sessions: DataFrame, titles: DataFrame, untitled: str = "Untitled Session") -> DataFrame:
    """titles: (session_id, title); only where the name is still the default, 30 characters at most, never blank."""
    again = titles.groupBy("session_id").count().where("count > 1").first()
    if again:
        raise ValueError(f"several titles for session {again['session_id']!r}")
    new = F.substring(F.nullif(F.trim("title"), F.lit("")), 1, 30)
    return sessions.join(titles, "session_id", "left").withColumn("session_name", F.when((F.col("session_name") == untitled) & new.isNotNull(), new).otherwise(F.col("session_name"))).drop("title")


def latest_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, text, blank) of the newest user message."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.withColumn("blank", F.coalesce(F.trim("text"), F.lit("")) == "")


def prompt(messages: DataFrame, system: str, context: Column | None = None) -> DataFrame:
    """(conv_id, prompt): the system message, with its context, before the session's messages in order."""
    head = F.lit(system) if context is None else F.concat_ws("\n", F.lit(system), context)
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return messages.groupBy("conv_id").agg(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.first(head).alias("text"))), body).alias("prompt"))
