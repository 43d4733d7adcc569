"""Compositions of operators into whole tables: weekly weather, training rows, models, risk."""
