"""tablewright.functions"""
