"""Spark-native abuse analytics for mail and message logs."""

from postwarden.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
