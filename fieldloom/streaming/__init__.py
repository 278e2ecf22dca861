"""fieldloom.streaming"""
