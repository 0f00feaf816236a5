"""DataFrame operators: search, views, correlation, alerts, detection, replay, coverage and more."""
