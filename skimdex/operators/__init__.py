"""Predicates, intervals, index choice, statistics, scans and index-order strategies."""
