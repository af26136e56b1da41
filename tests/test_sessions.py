"""Chat transactions: verdicts, atomic batches, and writers that meet."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import Conflict, NotFound
from tessera.operators.sessions import SessionStore

AT = "timestamp '2024-01-01'"


@pytest.fixture
def store(spark, tmp_path):
    return SessionStore(spark, f"file://{tmp_path}/chat", fanout=5)


def ask(spark, *rows, schema):
    return spark.createDataFrame(list(rows), schema).withColumn("created_at", F.expr(AT))


def creates(spark, *rows):
    """(user, session, known, victim)."""
    return ask(spark, *((u, s, "Untitled Session", k, v) for u, s, k, v in rows), schema="user_id string, session_id string, session_name string, known array<string>, victim string")


def claims(spark, *keys):
    return ask(spark, *((s, r, "m", "hello") for s, r in keys), schema="session_id string, round_id long, msg_id string, text string")


def answers(spark, *keys):
    return ask(spark, *((s, r, role, "m", "answer") for s, r in keys for role in ("system", "assistant")), schema="session_id string, round_id long, role string, msg_id string, text string")


def status(df, *keys):
    return {tuple(r[k] for k in keys): r["status"] for r in df.collect()}


def by_session(df):
    return {k[0]: v for k, v in status(df, "session_id").items()}


def test_create_and_limit(spark, store):
    assert by_session(store.create(creates(spark, ("u", "a", [], None), ("v", "x", ["ghost"], None)))) == {"a": "ok", "x": "conflict"}
    assert by_session(store.create(creates(spark, ("u", "a", ["a"], None)))) == {"a": "conflict"}  # the id is taken
    assert by_session(store.create(creates(spark, ("u", "b", ["a"], None), ("u", "c", ["a"], None)))) == {"b": "ok", "c": "conflict"}
    # at the limit the session touched longest ago makes room, no other
    store.finalize(answers(spark, ("a", 0))), store.claim(claims(spark, ("a", 0)).withColumn("created_at", F.expr("timestamp '2024-06-01'"))), store.finalize(answers(spark, ("a", 0)))
    assert [r["session_id"] for r in store.listed().orderBy("last_touched_at").collect()] == ["b", "a"]
    assert by_session(store.create(creates(spark, ("u", "d", ["b", "a"], "a")), most=2)) == {"d": "conflict"}
    assert by_session(store.create(creates(spark, ("u", "d", ["b", "a", "a"], "b")), most=2)) == {"d": "ok"}
    assert sorted(r["session_id"] for r in store.listed().collect()) == ["a", "d"]
    assert by_session(store.create(creates(spark, ("u", "e", ["a", "d"], "a")), most=1)) == {"e": "error"}
    with pytest.raises(Conflict):
        store.create(creates(spark, ("u", "f", [], None), ("w", "g", [], None)), strict=True)
    assert store.table("sessions").where("session_id IN ('f', 'g')").count() == 0


def test_update_and_titles(spark, store):
    store.create(creates(spark, ("u", "a", [], None), ("v", "b", [], None)))
    change = lambda *rows: spark.createDataFrame(list(rows), "user_id string, session_id string, before_session_name string, after_session_name string")
    assert by_session(store.update(change(("u", "a", "Untitled Session", "mine"), ("v", "b", "other", "x"), ("v", "none", "x", "y")))) == {"a": "ok", "b": "conflict", "none": "not_found"}
    titles = spark.createDataFrame([("u", "a", "late"), ("v", "b", "  " + "t" * 40), ("v", "c", "x")], "user_id string, session_id string, title string")
    assert by_session(store.set_titles(titles)) == {"a": "conflict", "b": "ok", "c": "not_found"}
    assert {r["session_id"]: r["session_name"] for r in store.listed().collect()} == {"a": "mine", "b": "t" * 30}
    with pytest.raises(NotFound):
        store.update(change(("v", "none", "x", "y")), strict=True)


def test_rounds(spark, store):
    key = ("session_id", "round_id")
    assert status(store.claim(claims(spark, ("a", 0), ("a", 1), ("a", 1))), *key) == {("a", 0): "ok", ("a", 1): "ok"}
    assert status(store.claim(claims(spark, ("a", 0), ("a", 2))), *key) == {("a", 0): "conflict", ("a", 2): "ok"}
    assert store.table("messages").where("NOT is_deleted").count() == 0
    assert status(store.finalize(answers(spark, ("a", 0), ("a", 7))), *key) == {("a", 0): "ok", ("a", 7): "not_found"}
    assert sorted(r["role"] for r in store.table("messages").where("NOT is_deleted").collect()) == ["assistant", "system", "user"]
    assert status(store.finalize(answers(spark, ("a", 0))), *key) == {("a", 0): "conflict"}
    words = spark.createDataFrame([("a", 0, "good"), ("a", 1, "bad"), ("a", 2, "meh")], "session_id string, round_id long, feedback string")
    assert status(store.patch_feedback(words), *key) == {("a", 0): "ok", ("a", 1): "not_found", ("a", 2): "error"}
    assert [(r["role"], r["feedback"]) for r in store.table("messages").where("feedback IS NOT NULL").collect()] == [("assistant", "good")]
    gone = spark.createDataFrame([("a", 0), ("a", 5)], "session_id string, round_id long")
    assert status(store.delete_rounds(gone), *key) == {("a", 0): "ok", ("a", 5): "not_found"}
    assert status(store.delete_rounds(gone), *key) == {("a", 0): "not_found", ("a", 5): "not_found"}
    assert store.table("messages").count() == 5  # after merges too


def test_rival_is_seen(spark, store):
    """A rival claims a round between this writer's check and commit: the check is made again, one of them gets the conflict, nothing is lost."""
    rival, commit, once = SessionStore(spark, store.path), store.log.commit, [True]

    def late(entries, after):
        if once:
            once.clear()
            assert by_session(rival.claim(claims(spark, ("a", 0)))) == {"a": "ok"}
        return commit(entries, after)

    store.log.commit = late
    got = status(store.claim(claims(spark, ("a", 0), ("b", 0))), "session_id")
    assert got == {("a",): "conflict", ("b",): "ok"}
    assert sorted(r["session_id"] for r in store.table("messages").collect()) == ["a", "b"]
    with pytest.raises(Conflict):
        store.claim(claims(spark, ("b", 0), ("c", 0)), strict=True)
    assert store.table("messages").count() == 2


def test_merged(spark, store):
    for k in range(6):
        store.claim(claims(spark, ("s", k)))
    assert len(store.log.entries()) < 5 and store.table("messages").count() == 6 and store.table("sessions").count() == 0
