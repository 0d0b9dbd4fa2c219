import json
import os

import pytest

from sluiceway.operators import deadletters as D
from sluiceway.operators.sinks import SinkRegistry


class Sink:
    """Writes each event's payload to a folder; fails for some."""

    def __init__(self, path, bad=()):
        self.path, self.bad = path, bad

    def __call__(self, event):
        text = event["payload"].decode()
        if text in self.bad:
            raise TimeoutError(text)
        with open(os.path.join(self.path, event["target"] + "." + text), "a") as f:
            f.write("x")


def letter(i, prefix="sns://t"):
    return json.dumps({"originalPrefix": prefix, "lsn": f"0/{i}", "content": f"c{i}", "failureType": "T", "failureMessage": "", "deadLetteredAt": "2024-01-01T00:00:00Z"})


@pytest.fixture
def service(spark, tmp_path):
    def make(bad=(), queue=D.TableQueue):
        q = queue(spark, str(tmp_path / "queue"))
        rows = [(i, letter(i) if i != 4 else "{torn", i == 5) for i in range(1, 21)] + [(21, letter(21, "nats://n"), False)]
        q.put(spark.createDataFrame(rows, "receipt long, body string, in_flight boolean"))
        (tmp_path / "sent").mkdir(exist_ok=True)
        return D.DeadLetterService(q, SinkRegistry({"sns": Sink(str(tmp_path / "sent"), bad), "sqs": Sink(str(tmp_path / "sent"), bad)}), str(tmp_path / "results"))

    return make


def left(s):
    return sorted(r.receipt for r in s.queue.messages().collect())


def test_looking_changes_nothing(service):
    s = service()
    assert [r.receipt for r in s.list(6).orderBy("receipt").collect()] == [1, 2, 3, 5, 6] and s.list(500).count() == 9
    assert s.stats() == {"visible": 20, "in_flight": 1} and len(left(s)) == 21


def test_one_letter_is_published_and_then_deleted(service, tmp_path):
    s = service(bad=("c3",))
    assert s.replay(2)["outcome"] == "success" and s.replay(2) is None and 2 not in left(s)
    failed = s.replay(3)
    assert (failed["outcome"], failed["failure_type"], failed["failure_message"]) == ("publish_failed", "TimeoutError", "c3") and 3 in left(s)
    assert s.replay(21)["failure_type"] == "NoSinkForScheme" and s.replay(21, "SQS", "other")["outcome"] == "success"
    assert s.replay(4) is None and s.replay(99) is None
    assert s.replay(1, "sqs", " ")["scheme"] == "sns"
    assert sorted(os.listdir(tmp_path / "sent")) == ["other.c21", "t.c1", "t.c2"]


class Stuck(D.TableQueue):
    def delete(self, receipts):
        raise OSError("stuck")


class Half(D.TableQueue):
    def delete(self, receipts):
        return super().delete(receipts.filter("receipt % 2 = 0"))


def test_letters_that_cannot_be_deleted_stay(service, tmp_path):
    s = service(queue=Stuck)
    assert s.replay(2)["outcome"] == "success_delete_failed" and len(left(s)) == 21
    assert s.abandon(2) == "abandon_failed"
    assert (tmp_path / "sent/t.c2").read_text() == "x"


def test_many(service, tmp_path):
    s = service(bad=("c6", "c7"), queue=Half)
    none = {"success_delete_failed": 0, "publish_failed": 0, "success": 0}
    assert s.replay_many(3, dry_run=True) == none | {"total": 3, "dry_run": 3} and len(left(s)) == 21 and not os.listdir(tmp_path / "sent")
    assert s.replay_many() == {"total": 20, "success": 8, "success_delete_failed": 9, "publish_failed": 3, "dry_run": 0}
    assert left(s) == [1, 3, 4, 5, 6, 7, 9, 11, 13, 15, 17, 19, 21]
    assert all((tmp_path / "sent" / f).read_text() == "x" for f in os.listdir(tmp_path / "sent"))  # each once


def test_abandon(service, tmp_path):
    s = service()
    assert s.abandon(4) == "abandoned" and 4 not in left(s) and not os.listdir(tmp_path / "sent")
