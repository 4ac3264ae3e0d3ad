"""Readers.

``delimited``  A1, A2, C5 delimited files with separator sniffing and profiling
``listing``    A3, D1, D2 file listing and upload gates
``legacy``     A6 pipe-delimited legacy change logs
"""
