"""Column expressions: time, geometry, traffic rules and scalings.  All stay inside whole-stage code generation but ``geo.vincenty_km``."""
