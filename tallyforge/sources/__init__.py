"""Sources and sinks at the engine's boundary."""
