"""Keyed state of retries over restarts: each key once, due times and errors kept, the third failure given up."""

import json
import time

import pytest

from quillon.streaming import retries


def feed(path, name, rows):
    (path / "in").mkdir(exist_ok=True)
    (path / "in" / f"{name}.json").write_text("\n".join(json.dumps({"k": k, "q": q}) for k, q in rows))


def test_three_batches_with_a_crash_between(spark, tmp_path):
    log = tmp_path / "asked"
    log.write_text("")

    def ask():
        def answer(q):
            with open(log, "a") as f:
                f.write(f"{q}\n")
            if q.startswith("bad") or (q.startswith("late") and log.read_text().count(f"{q}\n") < 2):
                raise ValueError(f"no {q}")
            return f"re {q}"

        return answer

    def run(wait=0.0):
        time.sleep(wait)
        source = spark.readStream.schema("k string, q string").json(f"{tmp_path}/in")
        q = retries.answer_stream(source, "k", "q", ask, f"{tmp_path}/out", f"{tmp_path}/check", delay_ms=500)
        q.awaitTermination()

    old = spark.conf.get(retries.PROVIDER_CONF, None)
    try:
        feed(tmp_path, "a", [("1", "good"), ("2", "bad"), ("3", "late"), ("1", "again")])
        run()
        assert {r["k"]: r["output"] for r in retries.outcomes(spark, f"{tmp_path}/out").collect()} == {"1": "re good"}
        waiting = {r["k"]: (r["attempts"], r["error"]) for r in retries.outcomes(spark, f"{tmp_path}/out", retries.WAITING).collect()}
        assert waiting == {"2": (1, "ValueError: no bad"), "3": (1, "ValueError: no late")}
        # the results are written and the commit is lost: the batch runs again, over what it wrote
        last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        run()
        for n in range(3):
            feed(tmp_path, f"b{n}", [(f"new{n}", f"good{n}"), ("1", "once more")])
            run(0.8)
        done = [(r["k"], r["output"]) for r in retries.outcomes(spark, f"{tmp_path}/out").collect()]
        assert sorted(done) == [("1", "re good"), ("3", "re late"), *[(f"new{n}", f"re good{n}") for n in range(3)]]
        dead = [(r["k"], r["attempts"], r["error"]) for r in retries.outcomes(spark, f"{tmp_path}/out", retries.DEAD).collect()]
        assert dead == [("2", 3, "ValueError: no bad")]
        assert log.read_text().count("once more") == 0
    finally:
        if old:
            spark.conf.set(retries.PROVIDER_CONF, old)
        else:
            spark.conf.unset(retries.PROVIDER_CONF)


def test_a_task_that_fails_is_raised(spark, tmp_path):
    feed(tmp_path, "a", [("1", "x")])

    def broken():
        raise RuntimeError("no model")

    source = spark.readStream.schema("k string, q string").json(f"{tmp_path}/in")
    q = retries.answer_stream(source, "k", "q", broken, f"{tmp_path}/out", f"{tmp_path}/check", attempts=1)
    with pytest.raises(Exception, match="no model"):
        q.awaitTermination()
    spark.conf.unset(retries.PROVIDER_CONF)
