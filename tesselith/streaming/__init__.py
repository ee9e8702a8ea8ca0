"""Reserved: the engine's queries are batch queries over written layouts; there are no streaming operators."""
