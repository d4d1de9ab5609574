"""Message-log analytics on Spark: queues, topics, streams and the statistics they leave, as DataFrame operators.

Nothing reads a clock: every operator that needs the present takes ``as_of``.
"""
