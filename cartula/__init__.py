"""cartula: a PySpark-native engine for detecting, pseudonymising and preparing text with personal data."""
