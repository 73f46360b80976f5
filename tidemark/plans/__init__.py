"""The jobs a user calls, composed from operators and functions."""
