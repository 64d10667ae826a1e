"""Readers, contract rules, sinks, generators and the black-box runner."""
