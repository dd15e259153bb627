from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mailmine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("mailmine-tests", cores=4, **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
    })
    yield session
    session.stop()


MAIL = "row_id long, email_id string, subject string, body string, category string, tone string, sentiment string"


@pytest.fixture(scope="session")
def two_topics(spark):
    """Twenty meeting mails and twenty complaints, equal inside a group."""

    rows = [(i, f"M{i}", "A date for the roadmap", "Hello Noor,\n\nIs Tuesday fine for our roadmap meeting?\n\nCheers,\nToni",
             "meeting_request", "formal", "neutral") for i in range(20)]
    rows += [(20 + i, f"C{i}", "Issue with my order", "Dear Helpdesk,\n\nThe parcel arrived broken, which is unacceptable and a terrible mistake."
              "\n\nSincerely,\nKim", "complaint", "formal", "negative") for i in range(20)]
    return spark.createDataFrame(rows, MAIL)
