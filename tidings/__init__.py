"""Link news articles to the announcements they cite, as plain DataFrame functions on Spark."""

from tidings.session import get_session, tune

__all__ = ["get_session", "tune"]
