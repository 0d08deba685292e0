"""Plans: end-to-end runs composed from the operators (train/evaluate, sweep,
cross-validation) and the registered driver workloads."""
