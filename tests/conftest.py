import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "proofline-tests")
    yield session
    session.stop()


SUBMISSION = (
    "evidence_id bigint, received_at timestamp_ntz, application_id string, group_id string, sync_date string, "
    "date_is_ambiguous boolean, requires_review boolean, sync_status string, processing_status string, "
    "duplicate_of_id bigint, media_type string, raw_text string, confidence double, sender_identity string, "
    "sender_phone string, sender_external_id string, sender_name string, agent_id bigint"
)


@pytest.fixture(scope="session")
def submissions(spark):
    """Builds submissions from partial rows; the rest is a clean, usable report."""
    import datetime as dt

    def build(*rows: dict):
        names = [part.split()[0] for part in SUBMISSION.split(", ")]
        out = []
        for number, given in enumerate(rows, 1):
            base = dict(
                evidence_id=number, received_at=dt.datetime(2026, 7, 30, 8) + dt.timedelta(minutes=number), application_id="a",
                group_id="gr1.a", sync_date="2026-07-30", date_is_ambiguous=False, requires_review=False,
                sync_status="SUCCESS", processing_status="COMPLETED", duplicate_of_id=None, media_type="video",
                raw_text="rapport", confidence=0.9, sender_identity="70000001@c.us", sender_phone="70000001",
                sender_external_id=None, sender_name=None, agent_id=None,
            )
            base.update(given)
            out.append(tuple(base[n] for n in names))
        return spark.createDataFrame(out, SUBMISSION)

    return build
