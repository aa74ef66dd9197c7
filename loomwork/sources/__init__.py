"""Seeded generators and the counting sink of benchmarks."""
