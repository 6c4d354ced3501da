"""vatloom.operators"""
