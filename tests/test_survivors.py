"""Survivors kept up to date: the same as all batches deduplicated in one go."""

import random

import pytest

from tablecare import SemanticProfile, Survivors, deduplicate_leads
from tablecare.sources.published import Published

PROFILE = SemanticProfile.of({"email": "email", "mail": "email", "name": "full_name"})
ONE = SemanticProfile.of({"email": "email", "name": "full_name"})


def people(seed, n):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (i, pick(None, "A@x.org", "a@X.org ", "b@x.org", "c@x.org", " ", f"u{i}@x.org"), pick(None, "m@x.org", "n@x.org", f"v{i % 9}@x.org"),
         pick(None, "Ann", "Bob", ""), pick(None, 1.0, float("nan")))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def leads(spark):
    return lambda rows: spark.createDataFrame(rows, "row_id long, email string, mail string, name string, x double")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("profile,config,parts", [
    (PROFILE, None, 4),
    (ONE, None, 3),
    (PROFILE, {"remove_exact_duplicates": False}, 2),
    (PROFILE, {"remove_email_duplicates": False}, 2),
])
def test_batches_in_any_cut_give_the_same(spark, leads, tmp_path, profile, config, parts):
    rows = people(parts, 90)
    rng = random.Random(parts)
    rng.shuffle(rows)
    want = rows_of(deduplicate_leads(leads(rows), profile, config))
    store = Survivors(spark, str(tmp_path / "s"), profile, config, buckets=4)
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for batch in [*batches, batches[0]]:
        store.merge(leads(batch))
    assert rows_of(store.read().select("row_id", "email", "mail", "name", "x")) == want


def test_a_row_comes_back_when_what_beat_it_goes(spark, leads, tmp_path):
    """Row 1 loses its mail to row 0, whose email then goes to a fuller row with another mail."""
    store = Survivors(spark, str(tmp_path / "s"), PROFILE, buckets=3)
    store.merge(leads([(0, "a@x.org", "m@x.org", None, None), (1, "b@x.org", "m@x.org", None, None)]))
    assert [r["row_id"] for r in store.read().collect()] == [0]
    store.merge(leads([(2, "a@x.org", "n@x.org", "Ann", 1.0)]))
    assert sorted(r["row_id"] for r in store.read().collect()) == [1, 2]


def test_only_touched_buckets_are_written_and_failures_change_nothing(spark, leads, tmp_path, monkeypatch):
    store = Survivors(spark, str(tmp_path / "s"), ONE, buckets=8)
    store.merge(leads([(i, f"u{i}@x.org", None, "n", None) for i in range(60)]), batch_id=0)
    before = store.store.current()
    assert len(before.folders) == 8
    store.merge(leads([(100, "u7@x.org", None, "n", 1.0)]), batch_id=1)
    after = store.store.current()
    changed = [k for k in before.folders if before.folders[k] != after.folders[k]]
    assert len(changed) == 1 and after.number == 2 and store.read().count() == 60
    # A batch that comes again, and one that fails at the end.
    assert store.merge(leads([(0, "zzz@x.org", None, None, None)]), batch_id=1) == after
    want = rows_of(store.read())
    with monkeypatch.context() as m:
        m.setattr(Published, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge(leads([(200, "u8@x.org", None, "n", 1.0)]), batch_id=2)
    assert rows_of(store.read()) == want
    with pytest.raises(ValueError):
        store.merge(leads([(1, "a", "b", "c", 1.0)]).drop("x"))


def test_from_a_stream(spark, leads, tmp_path):
    rows = people(8, 60)
    for k in range(3):
        leads(rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Survivors(spark, str(tmp_path / "s"), PROFILE, buckets=2)
    stream = spark.readStream.schema(leads([]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it finds nothing new
        query = stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert rows_of(store.read()) == rows_of(deduplicate_leads(leads(rows), PROFILE))
    assert store.store.current().notes["batch"] == 2


def test_empty(spark, leads, tmp_path):
    store = Survivors(spark, str(tmp_path / "s"), PROFILE)
    with pytest.raises(ValueError):
        store.read()
    store.merge(leads([]))
    store.merge(leads([(1, "a@x.org", None, None, None)]))
    assert store.read().count() == 1
