"""fieldloom.functions"""
