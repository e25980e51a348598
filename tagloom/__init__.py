"""tagloom: a Spark-native engine for audio-file metadata.

Bytes are decoded into long-form event rows (``tagloom.sources``), resolved
into normalized records with plain DataFrame operators (``tagloom.operators``)
and queried through the registry in ``tagloom.plans``.
"""

__version__ = "0.1.0"
