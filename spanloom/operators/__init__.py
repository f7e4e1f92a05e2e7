"""Operators on general frames: exact tests, bootstraps, graph retrieval, stratified splits."""
