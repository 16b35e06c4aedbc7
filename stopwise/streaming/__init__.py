"""Realtime micro-batches and live windows."""
