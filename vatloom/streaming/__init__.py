"""vatloom.streaming"""
