"""DataFrame -> DataFrame operators. Each is usable with ``df.transform``."""
