"""DataFrame -> DataFrame operators: profiles, baselines, checks, score, reports."""
