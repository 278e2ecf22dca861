"""fieldloom.operators"""
