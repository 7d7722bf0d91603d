"""lakework: data-lake jobs, change feeds, raster and vector analytics on Spark DataFrames."""

from lakework.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
