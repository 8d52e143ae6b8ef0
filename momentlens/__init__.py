"""Moment analytics on Spark: timelines of speech, loudness and chat, many recordings at once."""
