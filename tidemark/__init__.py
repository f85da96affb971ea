"""tidemark: a PySpark-native engine for keyed logs.

Mutable keyed data is an ordered log of ``(key, value, seq, op)`` rows; every
result (snapshot, lookup, compaction, replication, reconciliation) is a
DataFrame computed from that log.
"""

__version__ = "0.1.0"
